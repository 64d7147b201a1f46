"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage is written as Parquet and read again as the next one's documents;
all but the last return the columns of documents.  A stage that has to find its
rows again gives each a key of its own first, so null and repeated doc_ids lose
or double nothing.  Columns other than those of documents are dropped by the
first stage; stages read these by name, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.llm.common import Workspace, closing_all, read
from slotwise.llm.decontaminate import with_items
from slotwise.llm.minhash import near_duplicates
from slotwise.llm.mixing import mixed
from slotwise.llm.quality import fit, score
from slotwise.llm.token_output import default_tokenizer, token_output

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_QUALITY = 0.3
END_ID = 2

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def keyed(docs, ws):
    """docs, written once, with a key _row of each row."""
    return ws.put(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "docs")


def keep_good(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject.

    Row by row: repeated rows and ids stay or go each by its own text, null and
    empty texts and texts of any length have a score, ties at the threshold
    stay.  Rows without a doc_id are scored and never learned from.  An empty
    table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    return score(docs, fit(docs, read(spark, sf_dir, "labels")), "_score").where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def keep_one_of_each(spark, docs, sf_dir):
    """One document of each group of near-duplicates: the one of the smallest doc_id, of several such rows the first.

    Rows are grouped by their texts alone, so rows of one doc_id with different
    texts are different documents; a row without a doc_id stays only where no
    one in its group has an id.  Documents without words, null and empty ones,
    are no duplicates of each other and stay.  An empty table gives no rows.
    """
    ws = Workspace(spark, "near")
    rows = keyed(docs, ws)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    gone = near_duplicates(rows.select(order.alias("doc_id"), "text"), within=ws).where("not kept").select("doc_id._row")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without any benchmark item.

    Row by row: repeated rows and ids, and rows without an id, stay or go each
    by its own text; null and empty texts stay.  An empty table gives no rows,
    an empty benchmark keeps all.
    """
    return with_items(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), "_items").where(F.size("_items") == 0).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    """What the mix takes: a row for each run of words of a document in an epoch, so documents may repeat.

    A run keeps its words' spacing; n_chars is its own length.  Rows take part
    each with its own text, whatever their ids; those of one doc_id stand in
    the order of their columns' hash.  Null and empty texts have no words and
    are never taken; a null source is a source of its own.  An empty table
    gives no rows.
    """
    ws = Workspace(spark, "mix")
    rows = keyed(docs, ws)
    at, taken = mixed(rows, ws, ("_row",), F.xxhash64("text", "lang", "n_chars"))
    # neighbouring blocks of a document that one epoch takes are one run
    w = W.partitionBy("_part", "sid", "_n", "epoch").orderBy("from")
    runs = taken.withColumn("_new", (F.coalesce(F.lag("to").over(w), F.lit(-1)) != F.col("from")).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = runs.groupBy("_part", "sid", "_n", "epoch", "_run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    runs = runs.groupBy("_part", "sid", "_n").agg(F.array_sort(F.collect_list(F.struct("epoch", "from", "to"))).alias("_runs"))
    own = at.select("_part", "sid", "_n", "_row").hint("merge").join(runs, ["_part", "sid", "_n"]).select("_row", "_runs")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    parts = rows.hint("merge").join(own, "_row").withColumn("_words", words)
    texts = F.transform("_runs", lambda r: F.array_join(F.slice(F.col("_words"), r["from"].cast("int") + 1, (r["to"] - r["from"]).cast("int")), ""))
    return parts.select("doc_id", F.explode(texts).alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def write_tokens(spark, docs, sf_dir):
    """doc_id, start, n_tokens and checksum of every run, read back from the written blocks.

    In ascending doc_id order, those without one first; repeated ids stay rows
    of their own; a null or empty text is the end id alone.  An empty table
    gives no rows.
    """
    return token_output(docs.select("doc_id", "text"), default_tokenizer(), END_ID)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token-ID output", write_tokens),
]


def run(spark, sf_dir):
    """All stages over the table documents."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with closing_all():
            docs = ws.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
