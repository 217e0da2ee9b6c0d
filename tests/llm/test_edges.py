"""NULLs, empty and repeated rows, empty tables and clashing column names: each operator's stated result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import bpe, decontaminate, html_text, line_dedup, ngram_join, pii, quality_rules, registry, secret_scan, suffix_dedup, token_store, words

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves.
CLASHES = "row _doc _text body node n comp lines ranges kept n_words rule ids leaks base added main key value h g at".split()
LONG = "word " * 30_000
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (None, "no id here"), (4, "same text twice"), (4, "same text twice"), (5, LONG), (6, LONG + "end")]


def odd_table(spark, rows=ODD):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs.withColumns({c: F.lit(None).cast("string") for c in CLASHES} | {"source": F.lit(None).cast("string")})


OPERATORS = {
    "op1": lambda s, d: suffix_dedup.dedup_substrings(d),
    "op2": lambda s, d: ngram_join.near_duplicate_stage(s, d, SF),
    "op3": lambda s, d: pii.find_pii(d, pii.fit(d)),
    "op4": lambda s, d: bpe.with_tokens(d),
    "op5": lambda s, d: decontaminate.find_leaks(d, words.read(s, SF, "benchmark")),
    "op6": lambda s, d: quality_rules.judge(d, quality_rules.fit(d, words.read(s, SF, "labels"))),
    "op7": lambda s, d: html_text.extract(d, html_text.Labeller.fresh(), page="text"),
    "op8": lambda s, d: secret_scan.candidates(d),
    "op9": lambda s, d: token_store.read_store(s, token_store.write_store(d, words_path(s))),
    "op10": lambda s, d: line_dedup.dedup_lines(d),
}


def words_path(spark):
    from sievework.session import scratch_path

    return scratch_path(spark, "tokens")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, odd_table(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(spark, name):
    rows = OPERATORS[name](spark, odd_table(spark)).collect()
    if name == "op8":
        assert rows == []
        return
    # op2: one of the two equal rows stays; the long texts have 1 and 2 shingles, so they do not link
    assert len(rows) == {"op2": 8}.get(name, len(ODD))
    if name == "op1":
        by_id = {r["row"]["doc_id"]: r for r in rows if r["row"]["doc_id"] is not None}
        assert by_id[1]["n_bytes"] == by_id[2]["n_bytes"] == 0 and by_id[4]["n_removed"] == 0
        assert by_id[6]["n_removed"] >= len(LONG) - 100
    if name == "op4":
        assert {len(r["ids"]) for r in rows if not r["row"]["text"]} == {0}
    if name == "op6":
        assert not any(r["kept"] for r in rows if not (r["row"]["text"] or "").strip())
    if name == "op10":
        gone = {r["row"]["doc_id"]: r["n_removed"] for r in rows}
        assert gone.pop(6) == 1  # one word more than the line of 5
        assert set(gone.values()) == {0}  # equal rows are one document


def test_benchmark_of_odd_rows(spark):
    docs = odd_table(spark, [(1, "a passage that is long enough to be found again in a text"), (2, None)])
    items = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (3, "passage that is long enough to be found again"), (3, "passage that is long enough to be found again")], "item_id bigint, text string")
    rows = decontaminate.find_leaks(docs, items).collect()
    assert [[x["item_id"] for x in r["leaks"]] for r in sorted(rows, key=lambda r: r["row"]["doc_id"])] == [[3], []]
    assert decontaminate.find_leaks(docs, items.limit(0)).where("size(leaks) > 0").count() == 0


def test_labels_of_one_kind_give_no_rules(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(5, 1), (6, 1), (4, None)], "doc_id bigint, quality int")
    assert quality_rules.fit(docs, labels) == []


def test_pipeline_stages(spark):
    docs = words.read(spark, SF, "documents")
    before = {r["doc_id"] for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        ids = [r["doc_id"] for r in done.select("doc_id").collect()]
        assert set(ids) <= before and len(ids) == len(set(ids)), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == columns, name
            docs, before = corpus_pipeline.staged(done, name), set(ids)
    assert {"token_ids", "decoded_text"} <= set(done.columns)
    assert done.where("not (decoded_text <=> text)").count() == 0


def test_pipeline_stages_on_odd_and_no_rows(spark):
    for docs in (odd_table(spark), odd_table(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


def test_registry_names_each_operator():
    names = registry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p title=don't>one</p><p>it's two</p>", ["one", "it's two"]),
        ("<p title='a>b' class = \"c'>d\">one</p>", ["one"]),
        ("<html><head><title>t</title><script>w('<div>')</script><meta name=a><p>one</p>", ["one"]),
        ("<head><noscript><link href=a><img src=b></noscript><meta name=c></head><p>one</p>", ["one"]),
        ("<div><p>one</p><button>go</div><p>two</p>", ["one", "two"]),
        ("<div><canvas><div>old</div>x</canvas><p>one</p></div>", ["one"]),
        ("<form><select><option>a<option>b</select>one</form><p>two", ["one", "two"]),
    ],
)
def test_op7_broken_markup_loses_no_text(page, blocks):
    assert [b.text for b in html_text.blocks_of(page)] == blocks
