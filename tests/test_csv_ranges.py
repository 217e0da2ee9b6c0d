"""Quoted multi-line CSV files cut into ranges at every place."""

import csv
import io
import random

import numpy as np
import pyarrow as pa
import pytest

from sievework.sources import csv_ranges, files

ROWS = [
    ["plain", "b", "1"], ["line\nbreak", 'say "x"', "2"], ["", "\n\n", "3"], ['""', ",", "4"], ["a,b\n,\"c\n\"", 'ü"\n', "5"],
    ["x\r\ny", "6 'q'", "6"], ["last", 'ends "', "7"],
]


def text_of(rows, end="\n", **options):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, **options).writerows(rows)
    return out.getvalue()


def read(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        return sorted((tuple(x if x != "" else None for x in r) for r in files.scan_csv(spark, path, {"a": "string", "b": "string", "n": "int"}, missing=("none",)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def expected(rows):
    return sorted(((a or None, b or None, int(n)) for a, b, n in rows), key=str)


def plain_states(lines, start):
    """Character by character: whether each line starts inside quotes, and the end."""
    out, inside = [start], start
    for line in lines:
        at_start, i = not inside, 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside = False
            elif at_start and c == '"':
                inside = True
            at_start = not inside and c == ","
            i += 1
        out.append(inside)
    return out


@pytest.mark.parametrize("start", [False, True])
def test_states_of_any_lines(start):
    rnd = random.Random(7)
    for _ in range(3000):
        lines = ["".join(rnd.choice('",a"') for _ in range(rnd.randrange(7))) for _ in range(rnd.randrange(1, 6))]
        effects = csv_ranges.line_effects(pa.array([x.encode() for x in lines], pa.binary()))
        assert csv_ranges.states(effects, start).tolist() == plain_states(lines, start), lines


def test_composition_of_ranges():
    rnd = random.Random(8)
    for _ in range(500):
        effects = np.array([rnd.randrange(4) for _ in range(rnd.randrange(1, 9))])
        cut = rnd.randrange(len(effects) + 1)
        whole = csv_ranges._composed(effects)
        assert whole == csv_ranges._composed(np.array([csv_ranges._composed(effects[:cut]), csv_ranges._composed(effects[cut:])]))


def cut_up(data, cuts, rows):
    """Batches of a few lines as Spark would read a file cut at these bytes: a line is read where it starts."""
    lines, at = [], 0
    for line in data.removesuffix(b"\n").split(b"\n"):
        start = max((c for c in [0, *cuts] if c < at), default=0)
        lines.append((start, line))
        at += len(line) + 1
    for i in range(0, len(lines), rows):
        part = lines[i : i + rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([9] * len(part), pa.int64()), pa.array([s for s, _ in part], pa.int64()), pa.array([x for _, x in part], pa.binary())], ["file", "at", "line"]
        )


def records_of(data, cuts, rows):
    held = csv_ranges.range_effects(cut_up(data, cuts, rows), ",")
    inside, state = set(), False
    for key in sorted(held):
        if state:
            inside.add(key)
        state = {csv_ranges.KEEP: state, csv_ranges.SWAP: not state, csv_ranges.OUTSIDE: False, csv_ranges.INSIDE: True}[held[key]]
    whole = [r for b in csv_ranges.split(cut_up(data, cuts, rows), inside, ",", False) for r in b.column(4).to_pylist()]
    edges = sorted((r["at"], r["kind"], r["first"], r["record"]) for b in csv_ranges.split(cut_up(data, cuts, rows), inside, ",", True) for r in b.to_pylist())
    chains = []
    for _, kind, first, record in edges:
        if kind == csv_ranges.HEAD:
            chains[-1][1].append(record)
        else:
            chains.append((first, [record]))
    assert [first for first, _ in chains].count(True) == 1
    return sorted(whole + [b"\n".join(x) for _, x in chains])


def test_cuts_at_every_byte():
    data = text_of([["a", "b", "n"], *ROWS]).encode()
    plain = sorted(text_of([r]).removesuffix("\n").encode() for r in [["a", "b", "n"], *ROWS])
    for rows in (1, 3, 1000):
        for cut in range(1, len(data)):
            assert records_of(data, [cut], rows) == plain
        for size in range(1, len(data)):
            assert records_of(data, list(range(size, len(data), size)), rows) == plain


@pytest.mark.parametrize("size", [24, 60])
def test_ranges_of_any_size_give_equal_rows(spark, tmp_path, size):
    (tmp_path / "one.csv").write_text(text_of([["a", "b", "n"], *ROWS]), newline="")
    assert read(spark, str(tmp_path), size) == expected(ROWS)


def test_many_files_line_ends_and_quoting(spark, tmp_path):
    more = [[f"r{i}\n", 'q"' * (i % 3), str(100 + i)] for i in range(40)]
    (tmp_path / "a.csv").write_text(text_of([["a", "b", "n"], *ROWS], "\r\n", quoting=csv.QUOTE_ALL), newline="")
    (tmp_path / "c.csv").write_text("")
    header = text_of([["a", "b", "n"]], "\r\n", quoting=csv.QUOTE_ALL)
    assert header.startswith('"a"')
    (tmp_path / "b.csv").write_text(header + "\n\n" + text_of(more).rstrip("\n"), newline="")
    for size in (150, 5000):
        assert read(spark, str(tmp_path), size) == expected(ROWS + more)
    (tmp_path / "d.csv").write_text("a,z,n\n1,2,3\n")
    with pytest.raises(ValueError, match="different headers"):
        read(spark, str(tmp_path), 5000)


def test_an_open_quote_at_the_end(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,n\n1,2,3\n"open\nstill,4,5')
    for size in (10, 100):
        assert len(read(spark, str(tmp_path), size)) == 2
