"""From landed raw files to rows: strict CSV, nested arrays and maps, tables under a preamble, tagged HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS_TYPE = "map<string,map<string,struct<label:string,units:map<string,array<struct<accn:string,start:date,end:date,val:decimal(20,2),form:string,filed:date>>>>>>"


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): a headed CSV read as text and cast; a row with a value that does not cast is rejected with its columns named."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path)
    cast = raw.select(*raw.columns, *[F.trim(F.col(f.name)).try_cast(f.dataType).alias(f"_{f.name}") for f in schema])
    bad = F.array_compact(F.array(*[F.when(F.col(f.name).isNotNull() & (F.trim(f.name) != "") & F.col(f"_{f.name}").isNull(), f.name) for f in schema]))
    cast = cast.withColumn("_bad", bad)
    good = cast.where(F.size("_bad") == 0).select(*[F.col(f"_{f.name}").alias(f.name) for f in schema])
    return good, cast.where(F.size("_bad") > 0).select(*raw.columns, F.array_join("_bad", "|").alias("rejected_columns"))


def explode_parallel(rows: DataFrame, arrays: dict[str, str], *keep: str) -> DataFrame:
    """A struct of arrays as rows, one per place; a short array gives nulls."""
    zipped = F.arrays_zip(*[F.col(source).alias(name) for name, source in arrays.items()])
    return rows.select(*keep, F.inline(zipped))


def flatten_facts(documents: DataFrame, column: str = "facts", taxonomy: str = "us-gaap", unit: str = "USD", *keep: str) -> DataFrame:
    """Nested taxonomy, concept, unit, observations as rows of one taxonomy and unit."""
    concepts = documents.select(*keep, F.explode(F.col(column)[taxonomy]).alias("taxonomy_concept", "_c"))
    seen = concepts.select(*keep, "taxonomy_concept", F.explode(F.col("_c.units")[unit]).alias("_o"))
    return seen.select(*keep, "taxonomy_concept", F.col("_o.accn").alias("accession"), "_o.start", "_o.end", F.col("_o.val").alias("value"), "_o.form", "_o.filed")


def archive_union(pages: list[DataFrame], first: str, last: str, key: str, start: str = "filing_from", end: str = "filing_to") -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): pages that overlap the window, exact copies once; keys with differing rows are conflicts."""
    whole = pages[0]
    for page in pages[1:]:
        whole = whole.unionByName(page, allowMissingColumns=True)
    rows = whole.where((F.col(start) <= F.lit(last).cast("date")) & (F.col(end) >= F.lit(first).cast("date"))).dropDuplicates()
    conflicts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")
    return rows.join(conflicts.select(key), key, "left_anti"), conflicts


def symbol_pairs(maps: DataFrame, column: str = "symbols") -> DataFrame:
    """Distinct (symbol, entity) pairs of a map of structs with ticker and cik, in standard form."""
    one = maps.select(F.explode(F.map_values(column)).alias("s"))
    pairs = one.select(F.upper(F.trim("s.ticker")).alias("symbol"), F.lpad(F.col("s.cik").cast("string"), 10, "0").alias("entity"))
    return pairs.where(F.col("symbol").rlike(r"^[A-Z][A-Z0-9.\-]*$")).dropDuplicates()


def request_list(rows: DataFrame, column: str = "ticker", longest: int = 15) -> DataFrame:
    """pos, symbol and problem (null for a usable row) of a requested list, in the order of column pos."""
    rows = rows.select("pos", F.upper(F.trim(column)).alias("symbol"))
    copies = rows.groupBy("symbol").agg(F.min("pos").alias("_first"))
    rows = rows.join(copies, "symbol", "left")
    bad = ~F.col("symbol").rlike(r"^[A-Z][A-Z0-9.\-]*$") | (F.length("symbol") > longest)
    problem = F.when(F.col("symbol").isNull() | (F.col("symbol") == ""), "EMPTY").when(bad, "INVALID_SYMBOL").when(F.col("pos") > F.col("_first"), "DUPLICATE")
    return rows.select("pos", "symbol", problem.alias("problem"))


def preamble_table(files: DataFrame, required: tuple[str, ...], content: str = "content", name: str = "file") -> DataFrame:
    """Rows of the table inside each text file that begins with free lines.

    The header is the only line that holds all required columns; the table ends at the first blank
    line after it. Returns file, as_of (the one "as of" date in the first twelve lines), row and a
    map of header to cell; a file without exactly one header and one date gives one row with problem.
    """
    lines = F.split(F.regexp_replace(content, "\r", ""), "\n")
    cells = lambda line: F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    indexed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"), cells(x).alias("cells")))
    rows = files.select(name, indexed.alias("lines"))
    heads = F.filter("lines", lambda x: F.size(F.array_except(F.array(*[F.lit(r) for r in required]), x["cells"])) == 0)
    dates = F.array_distinct(F.flatten(F.transform(F.slice("lines", 1, 12), lambda x: F.regexp_extract_all(x["line"], F.lit(r"as of,?\s*\"?([A-Z][a-z]{2} \d{1,2}, \d{4})"), F.lit(1)))))
    rows = rows.withColumn("heads", heads).withColumn("dates", dates)
    problem = F.when(F.size("heads") == 0, "NO_HEADER").when(F.size("heads") > 1, "SEVERAL_HEADERS").when(F.size("dates") != 1, "NOT_ONE_DATE")
    rows = rows.withColumn("problem", problem)
    head = F.element_at(F.col("heads"), 1)
    after = F.filter("lines", lambda x: x["i"] > F.col("head.i"))
    blank = F.array_min(F.transform(F.filter("after", lambda x: F.trim(x["line"]) == ""), lambda x: x["i"]))
    good = rows.where("problem is null").withColumn("head", head).withColumn("after", after).withColumn("stop", blank)
    good = good.withColumn("row", F.explode(F.filter("after", lambda x: F.col("stop").isNull() | (x["i"] < F.col("stop")))))
    ragged = F.size("row.cells") != F.size("head.cells")
    good = good.select(name, F.to_date(F.element_at("dates", 1), "MMM d, yyyy").alias("as_of"), (F.col("row.i") - F.col("head.i")).alias("row"), F.when(~ragged, F.map_from_arrays("head.cells", "row.cells")).alias("cells"), F.when(ragged, "RAGGED_ROW").alias("problem"))
    bad = rows.where("problem is not null").select(name, F.lit(None).cast("date").alias("as_of"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("map<string,string>").alias("cells"), "problem")
    return good.unionByName(bad)


def holding_classes(holdings: DataFrame, sectors: tuple[str, ...]) -> DataFrame:
    """Add class: first of NON_EQUITY, INVALID_SYMBOL, MISSING_SECTOR, UNKNOWN_SECTOR, DUPLICATE_SYMBOL, else CANDIDATE."""
    equity = F.col("asset_class") == "Equity"
    copies = holdings.where(equity).groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    rows = holdings.join(copies, "symbol", "left")
    kind = (
        F.when(~F.coalesce(equity, F.lit(False)), "NON_EQUITY").when(~F.coalesce(F.col("symbol").rlike(r"^[A-Z][A-Z0-9.\-]*$"), F.lit(False)), "INVALID_SYMBOL")
        .when(F.coalesce(F.trim("sector"), F.lit("")) == "", "MISSING_SECTOR").when(~F.col("sector").isin(*sectors), "UNKNOWN_SECTOR").when(F.col("_n") > 1, "DUPLICATE_SYMBOL").otherwise("CANDIDATE")
    )
    return rows.withColumn("class", kind).drop("_n")


#: Elements that leave the parser at once.
ELEMENTS = 10_000


def _tags():
    """Elements of HTML documents: one row per start tag with its attributes and the text up to its end.

    However many documents a batch holds, one document and ELEMENTS rows are in memory as Python objects.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.open: list[list] = []
                self.found: list[tuple] = []

            def handle_starttag(self, tag, attrs):
                item = [len(self.found), tag, {k: v or "" for k, v in attrs}, []]
                self.found.append(item)
                if tag not in ("br", "hr", "img", "input", "link", "meta"):
                    self.open.append(item)

            def handle_endtag(self, tag):
                for k in range(len(self.open) - 1, -1, -1):
                    if self.open[k][1] == tag:
                        del self.open[k:]
                        break

            def handle_data(self, text):
                if self.open and text.strip():
                    self.open[-1][3].append(text.strip())

        kinds = [("doc", None), ("position", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
        def table(rows, key):
            return pa.RecordBatch.from_arrays([pa.array(v, t or key) for v, (_, t) in zip(rows, kinds, strict=True)], names=[n for n, _ in kinds])

        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, html in zip(*batch.columns[:2], strict=True):
                reader = Reader()
                reader.feed(html.as_py() or "")
                for position, tag, attrs, text in reader.found:
                    for column, value in zip(rows, (doc.as_py(), position, tag, list(attrs.items()), " ".join(text)), strict=True):
                        column.append(value)
                    if len(rows[0]) == ELEMENTS:
                        yield table(rows, batch.column(0).type)
                        rows = [[], [], [], [], []]
            yield table(rows, batch.column(0).type)

    return run


def html_elements(documents: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, tag, attributes, text) of every element, read where the documents lie (no shuffle)."""
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, html).mapInArrow(_tags(), f"doc {kind}, position int, tag string, attributes map<string,string>, text string").withColumnRenamed("doc", key)


def tagged_facts(elements: DataFrame, key: str) -> DataFrame:
    """Facts of tagged HTML joined with their contexts: (key, name, text, unit, context_id, entity, start, end, dimensions, match).

    ``elements`` is read for the facts and again for the contexts. Positions count inside one reading only, since a document that was put together
    from rows may have its parts in another order the next time; a context's id therefore comes with its parts, and the two readings meet by id.
    """
    attribute = lambda n: F.col("attributes")[n]
    facts = elements.where(F.col("tag").isin("ix:nonfraction", "ix:nonnumeric")).select(key, "position", attribute("name").alias("name"), "text", attribute("unitref").alias("unit"), attribute("contextref").alias("context_id"), attribute("decimals").alias("decimals"))
    from pyspark.sql import Window

    parts = elements.where(F.col("tag").isin("xbrli:context", "xbrli:identifier", "xbrli:startdate", "xbrli:enddate", "xbrli:instant", "xbrldi:explicitmember"))
    owner = F.last(F.when(F.col("tag") == "xbrli:context", F.col("position")), ignorenulls=True).over(Window.partitionBy(key).orderBy("position"))
    pick = lambda t, c=F.col("text"): F.max(F.when(F.col("tag") == t, c))
    contexts = parts.withColumn("_at", owner).where("_at is not null").groupBy(key, "_at").agg(pick("xbrli:context", attribute("id")).alias("context_id"), pick("xbrli:identifier").alias("entity"), F.coalesce(pick("xbrli:startdate"), pick("xbrli:instant")).alias("start"), F.coalesce(pick("xbrli:enddate"), pick("xbrli:instant")).alias("end"), F.count_if(F.col("tag") == "xbrldi:explicitmember").alias("dimensions"))
    contexts = contexts.drop("_at")
    rows = facts.join(contexts, [key, "context_id"], "left")
    return rows.withColumn("start", F.col("start").try_cast("date")).withColumn("end", F.col("end").try_cast("date")).withColumn("match", F.when(F.col("entity").isNull(), "CONTEXT_NOT_FOUND").otherwise("FOUND"))


def latest_archive(spark: SparkSession, folder: str, pattern: str, model_date: str, archive: str | None = None) -> DataFrame:
    """Path and date of the newest archived file dated on or before a day; the date is the pattern's first group.

    With ``archive``, a pattern whose first group names the archive, there is a row for each of them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").option("recursiveFileLookup", True).load(folder).select("path")
    dated = files.withColumn("as_of", F.to_date(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")))).where(F.col("as_of") <= F.lit(model_date).cast("date"))
    groups = [F.regexp_extract("path", archive, 1).alias("archive")] if archive else []
    return dated.groupBy(*groups).agg(F.max_by("path", F.struct("as_of", "path")).alias("path"), F.max("as_of").alias("as_of"))
