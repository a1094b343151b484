"""Records with line breaks inside quotes, and files of several encodings, against Python's csv module."""

import csv
import io
import random

import numpy as np
import pytest

from rowassay.sources import csv as csv_source, records


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.fixture
def small_blocks(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def fields(rng, wide=False):
    odd = ['"', ",", "\n", "\r\n", "x", "é", " ", "\\", ";", "|", "猫", ""]
    return "".join(rng.choice(odd) for _ in range(rng.randint(0, 200 if wide else 6)))


def quoted(rows, end="\n", sep=","):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, delimiter=sep).writerows(rows)
    return out.getvalue()


def test_states_follow_the_reader():
    """The bit after random lines, as Python's reader leaves it, from both beginnings."""
    import re

    out, in_ = (re.compile(p.replace("\\z", "\\Z")) for p in records.opening(","))

    def left_open(text):
        try:
            list(csv.reader([text], strict=False))
            return list(csv.reader([text + "\x00x", ",y"], strict=False)).__len__() == 1
        except csv.Error:
            return None

    rng = random.Random(1)
    for _ in range(4000):
        line = "".join(rng.choice('"",,ab ') for _ in range(rng.randint(0, 9)))
        assert bool(out.search(line)) == left_open(line), line
        assert bool(in_.search(line)) == left_open('"' + line), line


def test_states_compose():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(0, 12))
        a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
        for start in (False, True):
            want = [start]
            for x, y in zip(a, b, strict=True):
                want.append(bool(y if want[-1] else x))
            assert records.states(a, b, start).tolist() == want


@pytest.mark.parametrize(("block", "end", "sep"), [(128, "\n", ","), (1 << 20, "\r\n", ";"), (400, "\r\n", "|"), (211, "\n", "^")])
def test_records_cross_blocks(spark, tmp_path, small_blocks, block, end, sep):
    rng = random.Random(block)
    files = {}
    for i in range(2):
        body = [[str(j), fields(rng, wide=j % 20 == 3), fields(rng)] for j in range(60)]
        files[f"f{i}.csv"] = body
        lead = [["a title"], ["two\nlines, " + fields(rng), "x"]]
        write(tmp_path / f"f{i}.csv", quoted([*lead, ["id", "te\nxt", "more"], *body, ["total"], ["end\nof", "file"]], end, sep))
    small_blocks(block)
    read = csv_source.read_csv(spark, str(tmp_path), sep=sep, skip_rows=2, skip_footer_rows=2, na_tokens=[])
    assert read.rows.columns == ["id", "te\nxt", "more"] and read.rejects.count() == 0
    assert block > 1000 or read.rows.rdd.getNumPartitions() > 3
    want = sorted(tuple(r) for body in files.values() for r in body)
    assert sorted(tuple(v or "" for v in r) for r in read.rows.collect()) == want


def test_multiline_without_skips(spark, tmp_path, small_blocks):
    small_blocks(32)
    text = '\n\na,b\n"x\ny",1\n\n5" pipe,"in ""q"" \n\n end"\nlast,"open\nto the end'
    read = csv_source.read_csv(spark, write(tmp_path / "m.csv", text), multiline=True)
    assert sorted(tuple(r) for r in read.rows.collect()) == [('5" pipe', 'in "q" \n\n end'), ("last", "open\nto the end"), ("x\ny", "1")]


def test_skips_leave_nothing(spark, tmp_path):
    read = csv_source.read_csv(spark, write(tmp_path / "n.csv", "a,b\n1,2\n"), skip_footer_rows=5)
    assert read.rows.columns == ["a", "b"] and read.rows.count() == 0
    assert csv_source.read_csv(spark, write(tmp_path / "e.csv", ""), multiline=True).rows.columns == []


def test_headers_by_name_after_skips(spark, tmp_path):
    write(tmp_path / "a.csv", "t\na,b\n1,2\n")
    write(tmp_path / "b.csv", "t\n\nb,a\n4,3\n")
    read = csv_source.read_csv(spark, str(tmp_path), skip_rows=1)
    assert sorted(tuple(r) for r in read.rows.collect()) == [("1", "2"), ("3", "4")]
    write(tmp_path / "c.csv", "t\nb,c\n4,3\n")
    with pytest.raises(ValueError, match="columns"):
        csv_source.read_csv(spark, str(tmp_path), skip_rows=1)


def test_separators(spark):
    for sep in ("::", '"', "\n"):
        with pytest.raises(ValueError):
            records.opening(sep)


@pytest.mark.parametrize("options", [{}, {"multiline": True}, {"skip_rows": 1}])
def test_encodings_by_file(spark, tmp_path, options):
    lead = "title\n" if options.get("skip_rows") else ""
    write(tmp_path / "u.csv", f"{lead}n,é\ncafé,1\n".encode())
    write(tmp_path / "l.csv", f"{lead}é,n\n2,naïve\n".encode("latin-1"))
    write(tmp_path / "b.csv", f"{lead}n,é\nœuf,3\n".encode("utf-8-sig"))
    write(tmp_path / "a.csv", f"{lead}n,é\nplain,4\n".encode())
    read = csv_source.read_csv(spark, str(tmp_path), **options)
    assert sorted(tuple(r) for r in read.rows.select("n", "é").collect()) == [("café", "1"), ("naïve", "2"), ("plain", "4"), ("œuf", "3")]
    assert read.encoding == "mixed" and [f.rsplit("/", 1)[1] for f in read.files["latin-1"]] == ["l.csv"]
