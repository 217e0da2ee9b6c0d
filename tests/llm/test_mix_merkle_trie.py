"""Mixing, the Merkle manifest and the prefix trie against plain versions, and their odd rows."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from sievework.llm import merkle, mixing, prefix_trie, registry  # noqa: E402
from sievework.llm.running import running  # noqa: E402

SF = "/root/testdata/sf0.001"
CLASHES = "row _doc _text _source _none size before _cell lane part path leaf depth conv k1 k2 n".split()


def clashing(df):
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHES})


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "conversations"):
        database.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    result = database.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    mine, theirs = (sorted((tuple(sorted(zip(columns, map(str, row)))) for row in rows)) for columns, rows in ((df.columns, df.collect()), (result.columns, result.fetchall())))
    assert mine == theirs


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 40}", i * 7919 % 500, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, x bigint")
    found = running(df, ["g"], ["o", "x"], {"x": 0}).collect()
    groups = defaultdict(list)
    for g, o, x in rows:
        groups[g].append((o, x))
    expected = set()
    for g, members in groups.items():
        total = 0
        for i, (o, x) in enumerate(sorted(members)):
            expected.add((g, o, x, i, total))
            total += x
    assert {tuple(r) for r in found} == expected


# mixing ---------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, excess, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while excess > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = sum(max(0.0, target[s] - 3 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def mixed_table(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "", "a", "b", "é", "Z", "none of it"]
    rows = []
    for doc in range(900):
        source = "a" if rnd.random() < 0.4 else rnd.choice(sources)
        words = 0 if source == "none of it" else rnd.choice([0, 1, 7, 7, 7, 30, 200])
        rows.append((doc if doc % 50 else None, rnd.choice(["", " \n"]) + "w " * words if words or doc % 2 else None, source))
    rows += [(5000, "same row", "b")] * 7
    return clashing(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))


@pytest.mark.parametrize("seed", [1])
def test_mix_meets_its_targets(spark, seed):
    docs = mixed_table(spark, seed)
    found = mixing.copies(docs).collect()
    assert len(found) == docs.count()
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["copies"] <= 3
    by_size = docs.select("source", mixing.word_count("text").alias("n")).groupBy("source").agg(F.sum("n"), F.max("n")).collect()
    sizes = {s: n for s, n, _ in by_size}
    longest = {s: m for s, _, m in by_size}
    expected = plain_targets(sizes)
    at = {(r["source_size"], round(r["target"], 6)) for r in found}
    assert at == {(sizes[s], round(expected[s], 6)) for s in sizes}
    for r in found:
        taken[r["source_size"], r["target"]] += r["copies"] * r["size"]
    for s in sizes:
        got = sum(v for (size, aim), v in taken.items() if size == sizes[s] and abs(aim - expected[s]) < 1e-6)
        if list(sizes.values()).count(sizes[s]) == 1:
            assert abs(got - expected[s]) <= 2 * longest[s]
    again = mixing.copies(docs.repartition(17, "text")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))

def test_mix_emits_rows_as_often_as_taken(spark):
    docs = mixed_table(spark, 3)
    taken = mixing.copies(docs).agg(F.sum("copies")).scalar()
    rows = mixing.mix(docs)
    assert rows.count() == docs.sparkSession.range(1).select(taken).first()[0]
    assert rows.columns == ["row", "copy"] and rows.where("copy > 3").count() == 0
    assert rows.select("row.*").columns == docs.columns


def test_mix_of_nothing(spark):
    docs = mixed_table(spark, 1)
    assert mixing.copies(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []
    blank = docs.withColumn("text", F.lit(None).cast("string")).limit(5)
    assert {(r["target"], r["copies"]) for r in mixing.copies(blank).collect()} == {(0.0, 0)}


# Merkle manifest ------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout):
    """{(doc, leaf): (subroot, root, siblings)} from (doc, source, leaf) rows."""

    def tree(nodes):
        paths = [[] for _ in nodes]
        spot = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(spot):
                start = at - at % fanout
                paths[i] += [x for k, x in enumerate(nodes[start : start + fanout], start) if k != at]
            spot = [at // fanout for at in spot]
            nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        return nodes[0], paths

    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        parts[s] = own, *tree([r[2] for r in own])
    root, upper = tree([parts[s][1] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        own, subroot, paths = parts[s]
        out += [(r[0], r[2], subroot, root, sha(*path, *above)) for r, path in zip(own, paths)]
    return sorted(out, key=str)


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


@pytest.mark.parametrize("fanout,levels,sources", [(2, 1, 5), (3, 2, 11), (4, 1, 1)])
def test_manifest_matches_a_plain_tree(spark, fanout, levels, sources):
    rnd = random.Random(fanout)
    names = [None, "", *[f"s{i}" for i in range(sources)]] if sources > 1 else ["only"]
    rows = [(rnd.randrange(400) if rnd.random() < 0.98 else None, "hot", "en", None, rnd.choice(["", None, "Äb", "text"])) for _ in range(300)]
    rows += [(i, rnd.choice(names), None, i, "T" * i) for i in range(60)]
    rows += [(7, names[0], "de", 1, "same")] * 3
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string"))
    found = merkle.manifest(docs, fanout=fanout, levels=levels).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in found)
    mine = sorted(((r["_doc"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in found), key=str)
    assert mine == plain_manifest([(r[0], r[1], plain_leaf(*r)) for r in rows], fanout)


def test_tampering_is_seen_and_proofs_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = merkle.manifest(docs, tampered={"text": F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("text"))}, with_proof=True).collect()
    for r in found:
        assert r["verified"] == (r["_doc"] % 7 != 0)
        digest = r["leaf"]
        for own, others in r["proof"]:
            digest = sha(*others[:own], digest, *others[own:])
        assert digest == r["root"]
        assert r["proof_sha256"] == sha(*[x for _, others in r["proof"] for x in others])


def test_manifest_of_nothing_and_of_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert merkle.manifest(docs.limit(0)).collect() == []
    (one,) = merkle.manifest(docs.limit(1)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")


# Prefix trie ----------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    """Sorted result rows from (conv, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ending = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ending[whole].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        words = len(brute.WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * words
    return sorted(
        (min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node],
         sha(",".join(map(str, sorted(ending[node])))))
        for node, held in members.items()
    )


def talk(seed, convs=260):
    rnd = random.Random(seed)
    lines = [f"line {i} " + "w " * rnd.randrange(6) for i in range(4)]
    rows = []
    for c in rnd.sample(range(400), convs):
        n = rnd.choice([0, 1, 2, 3, 5, 9])
        if c % 3 == 0:  # a third are copies
            rows += [(c, t, "user", f"copied {t} a b") for t in range(6)]
        for t in range(n if c % 3 else 0):
            rows.append((c, rnd.choice([t, t, None]), rnd.choice(["user", None, ""]), rnd.choice([*lines, None, f"own {c}"])))
    rows += [(777, t, "user", f"turn {t}") for t in range(300)] + [(778, t, "user", f"turn {t}") for t in range(250)]
    return rows + [(None, 1, "user", "lost")] * 3


@pytest.mark.parametrize("seed,widest", [(1, prefix_trie.WIDEST), (2, 64)])
def test_trie_matches_a_plain_one(spark, seed, widest):
    rows = talk(seed)
    table = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    found = prefix_trie.trie(table.repartition(5), widest=widest).select(*columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain_trie(rows), key=str)


def test_screening_proves_singletons_only(spark):
    keys = spark.range(4000).select(F.xxhash64(F.col("id") % 3000).alias("k1"), F.xxhash64(F.col("id") % 3000, F.lit(1)).alias("k2"))
    found = prefix_trie.screened(keys, 4000).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.bool_or("single").alias("single")).collect()
    assert not any(r["single"] for r in found if r["n"] > 1)
    assert sum(r["single"] for r in found) > 0.9 * sum(r["n"] == 1 for r in found)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(table).collect() == []
