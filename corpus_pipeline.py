"""The corpus pipeline: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, jaccard_join, packing, pii, toxicity
from loomspan.llm.common import discard, durable, read_table
from loomspan.llm.components import spread_join
from loomspan.llm.linear import fold

#: A document goes at this toxicity score or above.
TOXIC = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A name for a working column that no column of docs has, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled rows that the operator's query learns from."""
    training = F.coalesce(fold(F.col("doc_id"), toxicity.FOLDS) != 0, F.lit(False))
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), "toxic", training)
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # names that need no quotes and clash with none
    return toxicity.score(plain, model).where(F.col("toxicity") < TOXIC).drop("toxicity").toDF(*docs.columns)


#: Ids up to this many (8 bytes each, so 8 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its own for each row, and that column's name: a row number, stored because a second run might deal the rows otherwise."""
    key = _free(docs, "row_key")
    return durable(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(keyed: DataFrame, key: str, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in the keyed rows whose keys are not among the stored ones, whose number is counted before they are broadcast."""
    kept = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the row with the least id; nulls come last, and one row of several with that id
    stays. Rows are told apart by number, so equal ids or null ids alone make no copies, and texts without words stay."""
    keyed, key = _keyed(docs)
    groups = durable(jaccard_join.similar(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, num=80, den=100).select(F.col("doc_id").alias("key"), "component_id"), "groups")
    several = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    members = durable(spread_join(groups, several, "component_id", "key").join(keyed.select(F.col(key).alias("key"), "doc_id"), "key"), "members")
    discard(groups)
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first"))
    gone = durable(spread_join(members, first, "component_id", "key").where("first <> key").select(F.col("key").alias(key)), "gone")
    discard(members)
    return _without(keyed, key, gone, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    keyed, key = _keyed(docs)
    index = decontaminate.build_index(keyed.select(F.col(key).alias("doc_id"), "text"))
    hits = decontaminate.search(index, read_table(spark, sf_dir, "benchmark"))
    gone = durable(hits.where("size(hits) > 0").select(F.col("doc_id").alias(key)).distinct(), "gone")
    discard(index)
    return _without(keyed, key, gone, docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in angle brackets; n_chars follows the text. The other columns travel as one, so none meets a name that the operator uses."""
    rest = _free(docs, "other_columns")
    found = pii.detect(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(rest)))
    candidates = durable(found.select("candidates"), "candidates")
    model = pii.fit(candidates)
    discard(candidates)
    clean = pii.redact(pii.label(found, model))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return clean.select(*[new.get(c, F.col(rest)[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages hold trained models and token ids, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
