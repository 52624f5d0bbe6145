from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.sources import experience

BASE = "77 1 2 8 {chunk}1.5 2.5 2.0 0.25 0.5 12 0.75"
LATER = " 2.25 10.0 8.0 1.125 6"
LATEST = " 3 4 5 6 7 8 9.5 2.125 1.5 0.875 0.25 11"
FILES = {
    1: [BASE.format(chunk="")],
    2: ["EXPERIENCE_V2", BASE.format(chunk="") + LATER],
    3: ["EXPERIENCE_V3", BASE.format(chunk="64 ") + LATER],
    4: ["EXPERIENCE_V4", BASE.format(chunk="64 ") + LATER + LATEST],
}


@pytest.mark.parametrize("version", FILES)
def test_every_layout_is_read(spark, tmp_path, version):
    (tmp_path / "db.txt").write_text("\n".join([*FILES[version], "", "not a record", "77 1 2", *FILES[version][-1:]]) + "\n")
    rows = experience.read_experience(spark, f"file://{tmp_path}/db.txt").collect()
    assert len(rows) == 1
    row = rows[0].asDict()
    assert (int(row["fingerprint"]), row["engine"], row["strategy"], row["job_count"], row["sample_count"], row["confidence"]) == (77, 1, 2, 8, 12, 0.75)
    assert row["chunk_size"] == (64 if version >= 3 else 0)
    assert (row["average_runtime_correction"], row["prediction_sample_count"]) == ((1.125, 6) if version >= 2 else (1.0, 0))
    assert (row["kind_bucket"], row["decayed_success_rate"], row["outcome_sample_count"]) == ((3, 0.875, 11) if version == 4 else (0, 0.5, 0))


def test_what_is_written_is_read(spark, tmp_path):
    rows = spark.range(200).select((F.lit(str(2**63 - 100)).cast("decimal(20,0)") + F.col("id")).cast("decimal(20,0)").alias("fingerprint"), *[(F.col("id") % 7 + F.lit(0.1 if kind == "double" else 0)).cast(kind).alias(name) for name, kind, _, _ in experience.FIELDS[1:]])
    path = f"file://{tmp_path}/db"
    for _ in range(2):  # the second replaces the first
        experience.write_experience(rows.repartition(5), path)
    found = experience.read_experience(spark, path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    short = rows.select(*[name for name, _, first, _ in experience.FIELDS if first == 1])
    experience.write_experience(short, path)
    assert experience.read_experience(spark, path).select("decayed_success_rate").distinct().collect()[0][0] == 0.5


def test_later_lines_count_and_unknown_versions_do_not(spark, tmp_path):
    good = FILES[4][1]
    (tmp_path / "twice.txt").write_text("\n".join(["EXPERIENCE_V4", good, good.replace(" 12 0.75", " 99 0.5"), good.replace("77 1", "78 1")]) + "\n")
    rows = {int(r["fingerprint"]): r["sample_count"] for r in experience.read_experience(spark, f"file://{tmp_path}/twice.txt").collect()}
    assert rows == {77: 99, 78: 12}
    (tmp_path / "new.txt").write_text("EXPERIENCE_V9\n" + good + "\n")
    with pytest.raises(ValueError, match="version"):
        experience.read_experience(spark, f"file://{tmp_path}/new.txt")
    with pytest.raises(ValueError, match="no record"):
        experience.write_experience(spark.range(1), f"file://{tmp_path}/none")
