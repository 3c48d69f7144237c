"""Code matching on a stream of issues and attempts.

Each micro-batch runs the batch recipe, which spreads even one very busy phone over many tasks;
keyed state would give a phone to a single task. Between batches only the live issue of each
phone is kept, in buckets of phones, of which a batch reads those it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from bazaarflow.functions import normalize_phone
from bazaarflow.operators.codes import TTL, judge_timeline
from bazaarflow.operators.skew import sliced_left_join
from bazaarflow.session import discard, materialise
from bazaarflow.streaming.batches import BATCH, Table, as_of_now, read_batches, start, write_batch
from bazaarflow.streaming.keyed import CELL_KEYS, FOLDERS, KeyedState

OUTCOMES = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("phone", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("outcome", T.StringType()),
])

_LIVE = T.StructType([
    T.StructField("phone", T.StringType()), T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("code", T.StringType()),
    T.StructField("purpose", T.StringType()), T.StructField("live", T.BooleanType()),
])


def match_code_stream(
    events: DataFrame, out: str, checkpoint: str, *, ttl: str = TTL, kind: str = "verify",
    profiles: Table | None = None, cell_keys: int = CELL_KEYS, folders: int = FOLDERS, once: bool = False,
) -> StreamingQuery:
    """Outcomes of attempts to ``out/outcomes``.

    ``events`` has event_id, phone, code, purpose, ts and is_issue (and ``kind`` when uses are
    mixed). Batches are taken in order of arrival; within one, rows go by time. ``cell_keys`` and
    ``folders`` are those of the ``KeyedState``. ``out`` belongs to one ``checkpoint``: a batch that
    it has is not written again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        issues = KeyedState(spark, f"{out}/live", _LIVE, "phone", F.col("live"), cell_keys, folders)
        if issues.applied(batch_id):  # its outcomes were written before
            return
        work = f"{out}/work/{BATCH}={batch_id}"
        arrived = materialise(_prepared(batch, kind, profiles), "codes", f"{work}/arrived")
        carried = issues.of(arrived.select("phone").distinct()).where("live").select(
            "event_id", "phone", "code", "purpose", "ts", F.lit(None).cast("string").alias("kind"),
            F.lit(True).alias("has_account"), F.lit(True).alias("is_issue"),
            F.lit(False).alias("as_kept"), F.lit(True).alias("carried"))
        judged = materialise(
            judge_timeline(arrived.unionByName(carried), ttl, path=f"{work}/sorted"), "codes", f"{work}/judged")
        write_batch(
            judged.where(~F.col("is_issue")).select(*OUTCOMES.names), f"{out}/outcomes", batch_id)
        issues.add(_held_after(judged), batch_id)
        discard(spark, work)

    return start(events, write, checkpoint, once=once)


def outcomes(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/outcomes", OUTCOMES).drop(BATCH)


def _prepared(batch: DataFrame, kind: str, profiles: Table | None) -> DataFrame:
    use = F.coalesce("kind", F.lit(kind)) if "kind" in batch.columns else F.lit(kind)
    canonical = normalize_phone(F.col("phone"))
    rows = batch.select(
        "event_id", canonical.alias("phone"), "code", "purpose", "ts",
        use.alias("kind"), "is_issue", F.col("phone").eqNullSafe(canonical).alias("as_kept"),
        F.lit(False).alias("carried"))
    if profiles is None:
        return rows.withColumn("has_account", F.lit(True))
    accounts = as_of_now(profiles).where(F.col("phone").isNotNull()).select(F.col("phone").alias("_account"))
    return sliced_left_join(rows, accounts, "phone", "_account", "event_id").withColumn(
        "has_account", F.col("_account").isNotNull()).drop("_account")


def _held_after(judged: DataFrame) -> DataFrame:
    """Each phone's last issue after the batch, and whether it can still be used.

    Places grow with the order of rows, so the last issue is used up exactly when the last
    attempt that used one up was judged against it.
    """
    last = F.max_by(
        F.col("issue"), F.when(F.col("is_issue"), F.col("issue")["place"])).alias("last")
    used = F.max(F.when(F.col("uses_up"), F.col("issue")["place"])).alias("used")
    return judged.groupBy("phone").agg(last, used).where(F.col("last").isNotNull()).select(
        "phone", F.col("last")["event_id"].alias("event_id"), F.col("last")["ts"].alias("ts"),
        F.col("last")["code"].alias("code"), F.col("last")["purpose"].alias("purpose"),
        (~F.col("last")["place"].eqNullSafe(F.col("used"))).alias("live"))
