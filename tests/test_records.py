"""CSV records against the csv module: line breaks in quoted cells, splits, headers, odd quotes."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from claimlens.sources import ingest
from claimlens.sources import records as R


def _state(line, inside, sep=","):
    """The state after a line by a character automaton."""
    i, start = 0, not inside
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"' and start:
            inside = True
        start = not inside and c == sep
        i += 1
    return inside


def test_line_effects_equal_an_automaton():
    rnd = random.Random(1)
    for _ in range(4000):
        line = "".join(rnd.choices('",ab', k=rnd.randint(0, 9)))
        out, into = _state(line, False), _state(line, True)
        want = {(False, True): R.KEEPS, (True, False): R.SWAPS, (False, False): R.OUTSIDE, (True, True): R.INSIDE}[out, into]
        assert R.line_effect(line) == want, line


def _rows(n, seed, width=3):
    rnd = random.Random(seed)
    words = ["a", "b c", 'say ""hi""', "x,y", "line\nbreak", "two\n\nbreaks", 'q"', "\n", "", "é"]
    return [[str(i), *(rnd.choice(words).replace('""', '"') for _ in range(width - 1))] for i in range(n)]


def _write(path, header, rows):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("split", ["64k", "300", "40"])
def test_breaks_in_cells_equal_the_csv_module(spark, tmp_path, split):
    """Small splits cut cells, also one cell over several splits."""
    _write(tmp_path / "a.csv", ["AMOUNT", "note", "PROV_NAME"], _rows(60, 1) + [["long", "z\n" * 200 + "end", "p"]] + _rows(5, 2))
    _write(tmp_path / "b.csv", ["note", "AMOUNT", "more\nlines"], _rows(40, 3))
    (tmp_path / "c.csv").write_text("AMOUNT,note\n1,plain\n\n2,5\" pipe\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = ingest.read_claims(spark, str(tmp_path))
        got = [tuple(r[c] for c in ("AMOUNT", "note", "PROV_NAME", "more\nlines")) for r in df.drop("_corrupt_record").collect()]
        parts = R.text_lines(spark, [str(tmp_path / "a.csv")]).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        for r in csv.DictReader(io.StringIO((tmp_path / name).read_text(), newline="")):
            want.append(tuple(r.get(c) or None for c in ("AMOUNT", "note", "PROV_NAME", "more\nlines")))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert parts > 1 or split == "64k"


def test_a_cell_that_is_never_closed_is_none(spark, tmp_path):
    (tmp_path / "a.csv").write_text('AMOUNT,note\n1,"a\nb"\n2,"open\n3,x\n4,y\n')
    lines = R.text_lines(spark, [str(tmp_path)])
    got = R.records(lines, R.file_table(lines)).orderBy("block", "i").collect()
    assert [r["value"] for r in got] == ["AMOUNT,note", '1,"a\nb"', '2,"open', "3,x", "4,y"]


def test_stray_quotes_do_not_spread(spark, tmp_path):
    body = "AMOUNT,note\n" + "".join(f'{i},5" pipe\n' for i in range(50)) + '51,"x\ny"\n52,z\n'
    (tmp_path / "a.csv").write_text(body)
    df = ingest.read_claims(spark, str(tmp_path))
    assert df.count() == 52 and df.filter(F.col("note") == "x\ny").first()["AMOUNT"] == "51"


def test_latin1_file_with_breaks_beside_utf8(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('AMOUNT,note\n1,"Caf\xe9\nbar"\n'.encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("﻿AMOUNT,note\r\n2,\"Ñ\r\nz\"\r\n3,w\r\n".encode())
    (tmp_path / "e.csv").write_text("")
    got = {r["AMOUNT"]: r["note"] for r in ingest.read_claims(spark, str(tmp_path)).collect()}
    assert got == {"1": "Café\nbar", "2": "Ñ\nz", "3": "w"}
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "e.csv").write_text("\n\n")
    assert ingest.read_claims(spark, str(tmp_path / "only")).count() == 0
