"""Folders of feeds, and changes of a stream whose rows come late, early and in any split."""

import random
from datetime import datetime, timedelta

import pytest

from bargainry.operators import history
from bargainry.sources import delimited
from bargainry.streaming import changes


def test_folder_of_feeds(spark, tmp_path):
    (tmp_path / "in/a b").mkdir(parents=True)
    (tmp_path / "in/one.csv").write_text('﻿ID , Name,note\r\n1,"a, ""b""\nc",x\r\n\r\n , ,\r\n2,d\r\n')
    (tmp_path / "in/a b/two%.tsv").write_text("name,x\tid\tid\n e \t8\t9\textra\n")
    (tmp_path / "in/three.csv").write_text("id,name,note\n5,\"\",n\n")
    (tmp_path / "in/only-a-header.csv").write_text("id,name\n")
    (tmp_path / "in/empty.csv").write_text("")
    got = delimited.read_feeds(spark, str(tmp_path / "in"))
    assert sorted(got.columns) == ["file", "id", "name", "name,x", "note"]
    assert sorted(((r.id, r.name, r.note, r["name,x"]) for r in got.collect()), key=str) == [("1", 'a, "b"\nc', "x", None), ("2", "d", None, None), ("5", None, "n", None), ("9", None, None, "e")]
    assert delimited.shape("a\tb,c") == (",", ("a\tb", "c")) and delimited.shape('"a, b"\tc\td') == ("\t", ("a, b", "c", "d"))


SCHEMA = "id string, deal_id string, price long, observed_at timestamp"
DAY = datetime(2024, 1, 1)


@pytest.fixture
def states(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield lambda: spark.conf.set(name, changes.STORE)
    spark.conf.set(name, before)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("split", [1, 3])
def test_any_split_gives_the_changes(spark, states, tmp_path, split):
    states()
    rng = random.Random(split)
    rows = [(f"i{i}", rng.choice("abc"), rng.choice([1, 2, None]), DAY + timedelta(hours=rng.randrange(60))) for i in range(120)]
    rows += [("n", None, 1, DAY), ("t", "a", 1, None)]
    rng.shuffle(rows)
    for n in range(split):
        add(spark, f"{tmp_path}/in", rows[n::split])
    add(spark, f"{tmp_path}/in", [("end", "end", 1, DAY + timedelta(days=90))])
    got = changes.changes_of_files(spark, f"{tmp_path}/in", SCHEMA, str(tmp_path), "30 days")
    sound = [r for r in rows if r[1] and r[3]]
    want = []
    for key in "abc":
        last = [object()]
        for i, _, price, _ in sorted((r for r in sound if r[1] == key), key=lambda r: (r[3], r[0])):
            if price != last[0] and not (price is None and last[0] is None):
                want.append((key, i, price))
            last = [price]
    assert sorted(((r.key, r.id, r.price) for r in got.collect()), key=str) == sorted(want, key=str)
    plain = history.change_only(spark.createDataFrame([r for r in sound if r[2]], SCHEMA))
    assert plain.count() > 0


def test_late_rows_and_forgotten_keys(spark, states, tmp_path):
    states()
    at = lambda d: DAY + timedelta(days=d)
    steps = [[("1", "a", 5, at(0)), ("2", "a", 5, at(1))], [("x", "z", 1, at(20))], [("late", "a", 7, at(2)), ("3", "a", 5, at(18))], [("y", "z", 1, at(60))], [("4", "a", 5, at(61))], [("end", "z", 1, at(300))]]
    for rows in steps:
        add(spark, f"{tmp_path}/in", rows)
        got = changes.changes_of_files(spark, f"{tmp_path}/in", SCHEMA, str(tmp_path), "2 days", forget_days=30)
    # 2 and 3 say what 1 said, "late" is behind the watermark, and by the time of 4 the key was forgotten
    assert sorted(r.id for r in got.where("key = 'a'").collect()) == ["1", "4"]


def test_a_store_that_cannot_hold_the_state(spark):
    with pytest.raises(ValueError, match="providerClass"):
        changes.change_stream(spark.createDataFrame([], SCHEMA), "1 day")


@pytest.mark.parametrize("split", [1, 4])
def test_a_key_is_forgotten_in_any_split(spark, states, tmp_path, split):
    """After 30 days without a row the next price is new, whether or not the watermark has passed by then."""
    states()
    rows = [(f"{key}{d}", key, price, DAY + timedelta(days=d)) for key in "ab" for d, price in ((0, 5), (10, 5), (39, 5), (69, 5), (70, 5), (71, None), (72, None))]
    for n in range(split):
        add(spark, f"{tmp_path}/in", rows[n::split])
    add(spark, f"{tmp_path}/in", [("end", "end", 1, DAY + timedelta(days=300))])
    got = changes.changes_of_files(spark, f"{tmp_path}/in", SCHEMA, str(tmp_path), "200 days", forget_days=30)
    assert sorted(r.id for r in got.where("key <> 'end'").collect()) == ["a0", "a69", "a71", "b0", "b69", "b71"]


def test_keys_share_states(spark, states, tmp_path):
    """A state for each key took calls from Python for each of them in each batch."""
    states()
    add(spark, f"{tmp_path}/in", [("1", "a", 1, DAY)])
    out = changes.change_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "1 day")
    assert "pmod(xxhash64(key" in out._jdf.queryExecution().analyzed().toString()
