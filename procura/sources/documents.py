"""From documents, with items or with a text only, to the rows of an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.functions.text import department_of, plain_filename
from procura.operators.items import fill_from_document
from procura.workspace import materialise

#: Items of one document stand together: an item's place is the document's times this, and its own.
PLACES = 10**9
NUMBERS = ("quantity", "unit_price", "total_price")


class TextItems:
    """Table function: the items of a text that holds a table, with their places."""

    def eval(self, text: str):
        from procura.sources.files import extract_items

        for place, item in enumerate(extract_items(text or "")):
            yield (place, item["name"], item["quantity"], item["unit"], item["unit_price"], item["total_price"], item["contractor"], item["date"])


TEXT_ITEM = "item_pos int, name string, quantity double, unit string, unit_price double, total_price double, contractor string, date string"


def _text(name: str) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def items_of_documents(documents: DataFrame) -> DataFrame:
    """One row an item, with ``ordinal``: the items a document carries or, if it carries none, those found in its text.

    Empty fields come from the document, then its metadata; the source is its
    ``source_file`` or file name. Items found in a text have the department that the file
    name tells. The column ``position``, if there is one, is the documents' order, else the
    order in which they are read. A document with neither items nor text gives no row.
    """
    if "position" not in documents.columns:
        documents = documents.withColumn("position", F.monotonically_increasing_id())
    docs = documents.withColumn("source_file", F.coalesce(_text("source_file"), _text("filename")))
    docs = materialise(docs, "documents")
    carries = F.coalesce(F.size("items") > 0, F.lit(False))
    carried = fill_from_document(docs.where(carries))
    fields = [c for c in carried.columns if c not in ("item_pos", "position")]

    texts = docs.where(~carries & (F.coalesce("raw_text", F.lit("")) != "")).select(
        "position", "raw_text", "source_file", F.coalesce(_text("contractor"), F.col("metadata")["contractor"]).alias("doc_contractor"),
        F.coalesce(_text("date"), F.col("metadata")["date"]).alias("doc_date"), department_of(plain_filename(F.coalesce("source_file", F.lit("")))).alias("department"),
    )
    found = texts.lateralJoin(F.udtf(TextItems, returnType=TEXT_ITEM)(F.col("raw_text").outer()))
    plain = {n: F.col(n).cast("decimal(38,10)").cast("string") for n in NUMBERS}
    plain |= {"contractor": F.coalesce(_text("contractor"), "doc_contractor", F.lit("")), "date": F.coalesce(_text("date"), "doc_date", F.lit(""))}
    known = {"name", "unit", "source_file", "department"}
    found = found.select(
        "position", "item_pos", *[plain[c].alias(c) if c in plain else F.col(c) if c in known else F.lit(None).cast("string").alias(c) for c in fields]
    )
    rows = carried.select("position", "item_pos", *fields).unionByName(found)
    place = F.col("position").cast("decimal(28,0)") * F.lit(PLACES).cast("decimal(10,0)") + F.col("item_pos")
    return rows.withColumn("ordinal", place.cast("decimal(38,0)")).drop("position", "item_pos")
