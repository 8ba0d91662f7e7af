"""Files of one part take one shuffle; longer ones among them give the same text."""

from helpers import cue_table, random_contents

from timedtext.operators import compose

FILES = {f"f{n}": random_contents(n, n) for n in (1, 3, 4, 5, 6, 40)}


def shuffles(spark, rows):
    """How many shuffles Spark has run for a table, once it knows that no file is long."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "3"}
    old = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    return sum("ShuffleQueryStage" in line for line in plan.splitlines())


def test_one_shuffle_from_cues_to_a_file(spark):
    assert shuffles(spark, compose.compose_srt(cue_table(spark, FILES))) == 1


def test_parts_of_short_and_long_files(spark):
    files = {name: [(at // 2, at + 9, c) for at, c in enumerate(cues)] for name, cues in FILES.items()}
    cues = cue_table(spark, files)
    # a cue without a file is in a text of its own
    cues = cues.unionByName(cues.where("file_id = 'f40'").selectExpr("null AS file_id", *cues.columns[1:]))
    texts = {r.file_id: r.text for r in compose.compose_srt(cues, part_cues=5).collect()}
    whole = {r.file_id: r.text for r in compose.compose_srt(cues).collect()}
    assert texts == whole and texts[None] == texts["f40"]
    parts = compose.compose_parts(cues, part_cues=5).where("file_id = 'f40'").orderBy("part").collect()
    assert len(parts) > 1 and "".join(p.text for p in parts) == texts["f40"]
    written = sum(bool(c.strip()) for _, _, c in files["f40"])
    assert texts["f40"].count(" --> ") == written
