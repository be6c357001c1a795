"""Quoted line breaks in files of many blocks, against Python's own reader."""

import csv
import io
import random

import numpy as np
import pytest

from quillfen.sources import readers, records


@pytest.fixture
def small_blocks(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cells(draw, n):
    pieces = ["plain", "a,b", 'say "yes"', "line\nbreak", "\n", '"', '""\n"', "crlf\r\nin", "x" * 150, "\n" * 9, "ünï", "a\n" * 60, "12"]
    return [[str(k), draw.choice(pieces), draw.choice(pieces) + draw.choice(pieces)] for k in range(n)]


def written(rows, head, terminator="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=terminator, quoting=quoting)
    w.writerow(head)
    w.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("terminator,quoting,skip", [("\n", csv.QUOTE_MINIMAL, 0), ("\r\n", csv.QUOTE_ALL, 0), ("\n", csv.QUOTE_ALL, 3)])
def test_records_equal_the_written_rows(spark, tmp_path, small_blocks, terminator, quoting, skip):
    draw = random.Random(skip + len(terminator))
    tables = [cells(draw, 60), cells(draw, 1), cells(draw, 25)]
    for k, rows in enumerate(tables):
        lead = 'a "note\n"more\nend"\n' if skip else ""
        (tmp_path / f"{k}.csv").write_bytes((lead + written(rows, ["id", "one", "two\nlines"], terminator, quoting)).encode())
    parts = spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions()
    assert parts > 20  # the longest file alone has many blocks
    df = readers._raw(spark, str(tmp_path), ",", "UTF-8", skip, True, None)
    assert df.columns == ["id", "one", "two\nlines"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(tuple(r) for rows in tables for r in rows)


def test_effects_are_those_of_reading_on(spark):
    draw = random.Random(3)
    lines = ["".join(draw.choice('",ab ') for _ in range(draw.randint(0, 9))) for _ in range(3000)] + ['"' + "x," * 40_000, '""' * 30_000]
    rows = spark.createDataFrame([(x,) for x in lines], "v string")
    got = {r.v: r.e for r in rows.select("v", records.line_effect(rows.v, ",").alias("e")).collect()}

    def end(line, inside):
        at = 0
        while True:
            if not inside and not line.startswith('"', at):
                cut = line.find(",", at)
                if cut < 0:
                    return 0
                at = cut + 1
                continue
            at += not inside
            while True:  # to the quote that closes
                close = line.find('"', at)
                if close < 0:
                    return 1
                if line.startswith('""', close):
                    at = close + 2
                    continue
                break
            cut, inside = line.find(",", close + 1), False
            if cut < 0:
                return 0
            at = cut + 1

    for line, effect in got.items():
        assert effect == end(line, False) + 2 * end(line, True), line


def test_states_compose():
    draw = np.random.default_rng(1)
    for _ in range(300):
        effect = draw.integers(0, 4, draw.integers(1, 12))
        for begin in (0, 1):
            state, want = begin, []
            for e in effect:
                state = int(e) >> state & 1
                want.append(state)
            assert records._states(effect, begin).tolist() == want


def test_plain_files_take_sparks_reader_and_heads_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"x"\n2,y\n')
    df = readers.read_delimited(spark, str(tmp_path))
    assert df.columns == ["id", "v"] and sorted(r.id for r in df.collect()) == [1, 2]
    assert "FileScan csv" in df._jdf.queryExecution().toString()
    (tmp_path / "b.csv").write_text('other,v\n3,"x\ny"\n')
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path))


def test_open_quote_and_empty_files(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,\"never\n" + "closed,\n" * 40)
    (tmp_path / "b.csv").write_text("")
    rows = readers._raw(spark, str(tmp_path), ",", "UTF-8", 0, True, None).collect()
    assert sorted(r.id for r in rows) == ["1", "2"]
    assert next(r.v for r in rows if r.id == "2").startswith("never\nclosed,\nclosed,")
    (tmp_path / "c.txt").write_text("")
    assert readers._raw(spark, str(tmp_path / "c.txt"), ",", "UTF-8", 1, True, None).count() == 0
