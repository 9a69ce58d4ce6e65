"""Tables by key: lookups skip data, changes leave other folders alone."""

import datetime as dt
import glob
import os
import random

from pyspark.sql import functions as F

from tellerflow.operators import chatlog
from tellerflow.operators.keyed_table import KeyedTable
from tellerflow.sources import files, schemas

START = dt.datetime(2024, 1, 1)


def log_rows(spark, n, users, seed=0):
    rng = random.Random(seed)
    # a third of all rows are user 1's
    rows = [(i, 1 if i % 3 == 0 else rng.randrange(users), f"m{i}", "r" * 50, "greeting", 0.5, START + dt.timedelta(minutes=i)) for i in range(n)]
    return files.store(spark.createDataFrame(rows, schemas.CHAT_HISTORY), "log-rows")


def scanned(frame):
    """Rows that the scan below a frame has given, and files it has read."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    plan = leaves.apply(0)
    if "AdaptiveSparkPlan" in plan.getClass().getName():
        plan = plan.executedPlan().collectLeaves().apply(0)
    metrics = plan.metrics()
    return metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()


def test_one_users_rows_are_read_from_few_row_groups(spark, tmp_path):
    rows = log_rows(spark, 20_000, 2000)
    before = spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "4096")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.size.row.check.min", "10")
    # small partitions stay apart, as large ones would
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = chatlog.ChatLog(spark, f"{tmp_path}/log", folders=4)
        log.append(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        conf.unset("parquet.page.size.row.check.min")
        conf.set("parquet.block.size", before) if before else conf.unset("parquet.block.size")
    everything, all_files = scanned(log.read())
    assert everything == 20_000
    user = next(r.user_id for r in rows.filter("user_id > 1").limit(1).collect())
    found, read_files = scanned(log.of(user))
    assert found < 20_000 / 20 and read_files < all_files
    want = {r.id for r in rows.filter(F.col("user_id") == user).collect()}
    assert {r.id for r in log.of(user).collect()} == want
    assert [r.id for r in chatlog.user_chats(log.of(user), user).collect()] == [
        r.id for r in chatlog.user_chats(rows, user).collect()]
    # the hot user lies in several files
    assert log.of(1).select(F.input_file_name()).distinct().count() > 1
    assert log.of(10**9).count() == 0


def test_a_key_that_is_absent_reads_no_rows(spark, tmp_path):
    names = files.store(spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("username"), "id"), "names")
    table = KeyedTable(spark, f"{tmp_path}/names", names.schema, "username", folders=2)
    table.append(names)
    present = names.limit(1).collect()[0]
    assert [r.id for r in table.of(present.username).collect()] == [present.id]
    # within the range of names: minimum and maximum don't tell, the Bloom filter does
    absent = present.username[:-1] + ("0" if present.username[-1] != "0" else "1")
    assert scanned(table.of(absent))[0] == 0
    assert scanned(table.of(present.username))[0] > 0


def times(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_a_change_rewrites_its_folders_only(spark, tmp_path):
    rows = log_rows(spark, 600, 60)
    log = chatlog.ChatLog(spark, f"{tmp_path}/log", folders=16)
    log.append(rows.filter("id < 300"))
    log.append(rows.filter("id >= 300"))
    before = times(f"{tmp_path}/log")
    gone = spark.createDataFrame([(1,), (5,), (10**6,)], "user_id long")
    log.clear(gone)
    after = times(f"{tmp_path}/log")
    same = {p for p in before if after.get(p) == before[p]}
    folders = lambda paths: {p.split("key_folder=")[1].split("/")[0] for p in paths}
    touched = {str(r[0]) for r in gone.select(log._place(F.col("user_id"))).collect()}
    assert folders(set(before) - same) <= touched and folders(same) == folders(before) - touched
    key = lambda frame: sorted(map(str, frame.collect()))
    assert key(log.read()) == key(rows.filter("user_id NOT IN (1, 5)"))
    # clearing again, and clearing all of a folder's users
    log.clear(gone)
    assert key(log.read()) == key(rows.filter("user_id NOT IN (1, 5)"))
    log.clear(rows.select("user_id"))
    assert log.read().count() == 0 and not times(f"{tmp_path}/log")
    log.append(rows)
    assert key(log.read()) == key(rows)


def test_accounts_are_replaced_by_key(spark, tmp_path):
    kind = "user_id long, account_type string, balance long"
    existing = spark.createDataFrame([(u, a, u) for u in range(50) for a in ("checking", "savings")], kind)
    incoming = files.store(spark.createDataFrame([(3, "savings", -1), (4, "loan", -2), (99, "savings", -3)], kind), "incoming")
    table = KeyedTable(spark, f"{tmp_path}/accounts", existing.schema, "user_id", ("account_type",), folders=8)
    table.append(existing)
    for _ in range(2):
        table.rewrite(incoming, lambda rows: chatlog.upsert_accounts(rows, incoming))
        want = chatlog.upsert_accounts(existing, incoming)
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))


def test_no_table_yet(spark, tmp_path):
    log = chatlog.ChatLog(spark, f"{tmp_path}/log")
    assert log.read().count() == 0 and log.of(1).count() == 0
    log.clear(spark.createDataFrame([(1,)], "user_id long"))
    assert log.read().count() == 0
