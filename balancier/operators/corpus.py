"""The document corpus: chunks with metadata, enrichment, maintenance, entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from balancier.functions import text as X

# Accepted column names of a knowledge sheet, best first.
SYNONYMS = {
    "title": ("title", "titre"),
    "content": ("content", "contenu", "body", "description"),
    "document_type": ("document_type", "type"),
    "ratio_code": ("ratio_code", "ratio"),
    "parameter_code": ("parameter_code", "parameter"),
}
PLAIN = ("category", "ratio_family", "regulation", "source")
DEFAULT_LANGUAGE = "fr"
ENTITY_TYPES = ("RATIO_CODE", "PARAMETER_CODE", "DATE", "DOMAIN")


def _first_filled(df: DataFrame, names: Sequence[str]) -> Column:
    have = [F.when(X.strip(n) != "", F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def keywords(c: Column) -> Column:
    parts = F.transform(F.split(c, r"[,;|]\s*"), lambda k: X.strip(k))
    return F.coalesce(F.filter(parts, lambda k: k != ""), F.array().cast("array<string>"))


def chunk_documents(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Sheet rows (lower-case column names) -> chunk rows; rows without content are dropped.

    A chunk starts with the row's code, if it has one. ``keep`` columns are carried along.
    """
    plain = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in PLAIN]
    filled = df.select(
        *keep,
        X.strip(_first_filled(df, SYNONYMS["title"])).alias("_title"),
        X.strip(_first_filled(df, SYNONYMS["content"])).alias("_content"),
        _first_filled(df, SYNONYMS["document_type"]).alias("document_type"),
        F.upper(X.strip(_first_filled(df, SYNONYMS["ratio_code"]))).alias("ratio_code"),
        F.upper(X.strip(_first_filled(df, SYNONYMS["parameter_code"]))).alias("parameter_code"),
        F.lower(X.strip(_first_filled(df, ["domain"]))).alias("domain"),
        keywords(_first_filled(df, ["keywords"])).alias("keywords"),
        F.coalesce(_first_filled(df, ["language"]), F.lit(DEFAULT_LANGUAGE)).alias("language"),
        *plain,
    ).filter(F.col("_content").isNotNull())
    code = F.coalesce("ratio_code", "parameter_code")
    prefix = F.coalesce(F.concat(F.lit("["), code, F.lit("]")), F.lit(""))
    title = F.coalesce("_title", X.strip(F.concat(prefix, F.lit(" — knowledge chunk"))))
    body = F.when(code.isNull(), F.col("_content")).otherwise(F.concat(prefix, F.lit(" — "), F.col("_content")))
    rest = [c for c in filled.columns if c not in ("_title", "_content")]
    # The whole text goes into the cutter and only its pieces come out.
    return filled.select(*rest, title.alias("title"), F.posexplode(X.chunks(body)).alias("chunk_no", "text"))


def enrich(chunks: DataFrame) -> DataFrame:
    """Fill missing codes and domain from the text, and add its words to the keywords."""
    whole = F.concat(F.coalesce("title", F.lit("null")), F.lit(". "), "text")
    ratio = F.coalesce("ratio_code", F.get(X.spotted(whole, X.RATIO_CODES), 0))
    parameter = F.coalesce("parameter_code", F.get(X.spotted(whole, X.PARAMETER_CODES), 0))
    none = F.coalesce(F.size("keywords"), F.lit(0)) <= 0
    partial = F.col("ratio_code").isNull() | F.col("parameter_code").isNull() | F.col("domain").isNull() | none
    own = F.coalesce("keywords", F.array().cast("array<string>"))
    merged = F.array_distinct(F.concat(own, X.tokens(whole), F.array_compact(F.array(ratio, parameter))))
    words = F.when(none, F.slice(merged, 1, 20)).when(partial, F.slice(merged, 1, 30)).otherwise(own)
    return chunks.withColumns(
        {"ratio_code": ratio, "parameter_code": parameter, "domain": F.coalesce("domain", X.domain(whole)), "keywords": words}
    )


def without_source(documents: DataFrame, source: str) -> DataFrame:
    """The corpus after deleting one source; rows without a source stay."""
    return documents.filter(~F.col("source").eqNullSafe(F.lit(source)))


def seed(existing: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Rows to append for a source: none if the corpus already has any of it."""
    rows = new.withColumn("source", F.lit(source))
    have = existing.filter(F.col("source") == source).select("source").distinct()
    return rows.join(have, "source", "left_anti").select(*new.columns, *([] if "source" in new.columns else ["source"]))


def counts(documents: DataFrame, seeded: str) -> DataFrame:
    """Documents by type, and how many of each the seed source brought."""
    return documents.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") == seeded).alias("seeded")
    )


def token_counts(documents: DataFrame, text: str) -> DataFrame:
    """(token, documents): in how many texts each token occurs."""
    return documents.select(F.explode(X.tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


def entities(
    messages: DataFrame, text: str, keys: Sequence[str], ratio_codes: Sequence[str] = X.RATIO_CODES,
    parameter_codes: Sequence[str] = X.PARAMETER_CODES,
) -> DataFrame:
    """(keys, entity_type, entity_value), each value once per message.

    Values are made distinct inside the message's own row, so nothing is shuffled.
    """
    lists = (
        X.spotted(text, ratio_codes),
        X.spotted(text, parameter_codes),
        F.array_distinct(X.iso_dates(text)),
        F.array_compact(F.array(X.domain(text))),
    )

    def typed_as(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("entity_value")))

    typed = [typed_as(kind, values) for kind, values in zip(ENTITY_TYPES, lists)]
    return messages.select(*keys, F.inline(F.concat(*typed)))
