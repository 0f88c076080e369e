import hashlib

from pyspark.sql import functions as F

from shelfspark.llm.chat_format import BUDGET, PROBE, escape, format_windows, op4_chat_format, read_windows, turn_tokens, unescape

HARD = [PROBE, "\\h", "\\\\h\\t", "####", "###= user: x </turn>\n### assistant: y </turn>\n", "</turn></turn>", "\\", "", "é🙂 ### \\### ", " </turn", ":", "\\c"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    got = df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("b")).collect()
    assert all(r["t"] == r["b"] and "###" not in r["e"] and "</turn>" not in r["e"] for r in got)


def conversations():
    rows = [(1, k, ("system", "user", "assistant")[min(k, 1) + (k % 2 == 0 and k > 0)], HARD[k % len(HARD)] * (1 + k)) for k in range(60)]
    rows += [(2, 0, "assistant", "x" * 9000), (2, 1, "user", "short"), (2, 2, "assistant", None), (2, None, None, "first")]
    rows += [(3, 0, "system", "only")] + [(None, 0, "us: er\n", "no id")] + [(4, 5, "assistant", "same")] * 3
    return rows


def test_read_back_everything(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    windows = format_windows(df)
    read = read_windows(windows).orderBy("conv_id", "window").collect()
    for conv in {r[0] for r in rows}:
        want = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        own = [r for r in read if r["conv_id"] == conv]
        assert [(t["role"], t["text"]) for r in own for t in r["turns"]] == [x[1:] for x in want]
        assert [t for r in own for t in r["targets"]] == [x[2] for x in want if x[1] == "assistant"]
        if want[0][1] == "system":
            assert all(r["formatted"].split("system: ")[0] in ("### ", "###= ") for r in own)
    long = [r for r in read if r["conv_id"] == 1]
    assert len(long) > 3 and all("###= " in r["formatted"] for r in long[1:])
    assert format_windows(df.limit(0)).count() == 0


def test_budget(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", "w" * (40 + 37 * k % 900)) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    body = read_windows(format_windows(df)).select("window", F.explode("turns").alias("t")).groupBy("window").agg(F.sum(turn_tokens(F.col("t.text"))).alias("n"))
    assert body.agg(F.max("n")).first()[0] <= BUDGET - 256


def test_query(spark, sf):
    got = {r["conv_id"]: r for r in op4_chat_format(spark, sf).collect()}
    said = f"user\n{PROBE}\nassistant\n{PROBE}\n"
    assert got[-7]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[-7]["loss_chars"] == len(PROBE) and got[-7]["loss_sha256"] == hashlib.sha256(PROBE.encode()).hexdigest()
