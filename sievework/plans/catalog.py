"""Every operator as a query over the driver tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.numbers import nonnull_count, portable_hash, repair_short_year
from sievework.functions.text import is_ascii, quoted_tokens, split_parts
from sievework.operators import filters, joins, lemmas, metrics, naive_bayes, one_vs_rest, phrases, profile, sampling, terms, trees
from sievework.operators.categories import count_categories, top_categories
from sievework.operators.missing import blank_sentinels
from sievework.operators.mutual_information import mutual_information, select_terms
from sievework.operators.neighbour_information import neighbour_information
from sievework.operators.order_stats import quantiles
from sievework.plans import models, recipes
from sievework.plans.experiment import GenreClassifier
from sievework.plans.prepare import fix_missing, prepare, transform_feature
from sievework.session import scratch_path, staged
from sievework.sources import arff, files, ingest
from sievework.streaming.ingest import ingest_new_files, stream_csv

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(column: str | Column, places: int = 6) -> Column:
    return F.round(column, places) + F.lit(0.0)


# ---- missing values -------------------------------------------------------

def sized_parts(spark, folder):
    """Parts whose size is missing where it was 1, 2 or 3."""
    return blank_sentinels(table(spark, folder, "part"), {"p_size": [1, 2, 3]})


def typed_events(spark, folder):
    """Events whose type is missing where it was 'error'."""
    return blank_sentinels(table(spark, folder, "events"), {"event_type": ["error"]})


def blanked(spark, folder):
    return sized_parts(spark, folder).select("p_partkey", "p_size")


def fill(strategy: str, *args) -> Query:
    def run(spark, folder):
        df = fix_missing(sized_parts(spark, folder), "p_size", strategy, args)
        return df.select("p_partkey", rounded(F.col("p_size").cast("double")).alias("p_size"))

    return run


def fill_mode(spark, folder):
    return fix_missing(typed_events(spark, folder), "event_type", "replace_missing_with_mode").select(
        "event_id", "event_type"
    )


def drop_missing(spark, folder):
    return filters.drop_missing(typed_events(spark, folder), "event_type").select("event_id", "event_type")


# ---- filters and shaping --------------------------------------------------

def not_equal_keep_null(spark, folder):
    parts = blank_sentinels(table(spark, folder, "part"), {"p_type": ["ECONOMY"]})
    return filters.differs(parts, "p_type", "STANDARD").select("p_partkey", "p_type")


def equal_filter(spark, folder):
    return filters.equals(table(spark, folder, "documents"), "lang", "en").select("doc_id", "source")


def range_filter(spark, folder):
    return filters.above(table(spark, folder, "orders"), "o_totalprice", 250000.0).select("o_orderkey", "o_totalprice")


def quantile_filter(spark, folder):
    return filters.above_quantile(table(spark, folder, "orders"), "o_totalprice", 0.6).select(
        "o_orderkey", "o_totalprice"
    )


def dedup_keep_first(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return filters.keep_first(lines, "l_orderkey", ["l_linenumber"])


def rename_columns(spark, folder):
    customers = table(spark, folder, "customer").withColumnsRenamed({"c_custkey": "id", "c_mktsegment": "segment"})
    return files.drop_columns(customers, ["c_name", "c_nationkey", "c_acctbal"])


def declared_types(spark, folder):
    parts = files.cast_declared(table(spark, folder, "part"), {"p_size": "nominal", "p_partkey": "real"})
    return parts.select("p_partkey", "p_size", "p_retailprice")


def year_repair(spark, folder):
    return table(spark, folder, "part").select("p_partkey", repair_short_year("p_size").alias("p_size"))


def nonnull_counts(spark, folder):
    parts = blank_sentinels(
        table(spark, folder, "part"), {"p_size": [1, 2, 3], "p_type": ["ECONOMY"], "p_brand": ["Brand#1", "Brand#2"]}
    )
    return parts.select("p_partkey", nonnull_count("p_size", "p_type", "p_brand").alias("present"))


def split_columns(spark, folder):
    parts = split_parts("p_name", " ", 3)
    named = [c.alias(f"word_{i}") for i, c in enumerate(parts, 1)]
    return table(spark, folder, "part").select("p_partkey", *named)


def feature_list() -> Column:
    """A quoted list with backslashes, as in raw feature columns."""
    return F.concat(
        F.lit('{"'), "p_name", F.lit('","'), F.col("p_brand"), F.lit('\\","'), F.col("p_type"), F.lit('","last"}')
    )


def quoted_token_columns(spark, folder):
    tokens = quoted_tokens(feature_list(), 3)
    return table(spark, folder, "part").select("p_partkey", *[c.alias(f"token_{i}") for i, c in enumerate(tokens, 1)])


def books_shape(spark, folder):
    raw = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("publisher"), F.lit("en").alias("language"),
        F.replace("p_name", F.lit(" "), F.lit("/")).alias("authors"), F.lit("0").alias("isbn"),
    )
    return recipes.preprocess_books(raw)


def movies_shape(spark, folder):
    """Orders' lines as movies: several lines share an id, lists are joined columns."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    raw = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_linestatus") == "O", "Untitled").when(line > 2, F.concat(F.lit("T"), line)).alias("title"),
        F.when(flag == "R", "Canceled").when(flag == "A", "Released").alias("status"),
        F.array_join(F.sequence(F.lit(1), line), ",").alias("keywords"),
        F.concat_ws(", ", "l_returnflag", "l_linestatus").alias("genres"),
        F.when(line > 1, F.concat_ws(",", "l_suppkey", "l_partkey", line)).alias("production_companies"),
        F.concat_ws(",", line, line, line, line, line).alias("production_countries"),
        "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", line.alias("line"),
        *[F.lit("").alias(c) for c in recipes.MOVIE_DROPPED],
    )
    shaped = recipes.preprocess_movies(raw, ["line", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return shaped.drop("l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")


def music_shape(spark, folder):
    raw = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("views"),
        F.when(F.col("p_size") > 30, F.col("p_size") + 1830).otherwise(F.col("p_size")).alias("year"),
        feature_list().alias("features"),
    )
    return recipes.preprocess_music(raw)


# ---- transforms -----------------------------------------------------------

def transform(name: str, key: str, column: str, action: str, *args, **kwargs) -> Query:
    def run(spark, folder):
        df = table(spark, folder, name).select(key, column)
        result = transform_feature(df, column, action, args, kwargs)
        is_number = dict(result.dtypes)[column] in ("double", "float")
        return result.select(key, (rounded(column) if is_number else F.col(column)).alias(column))

    return run


def line_bins(action: str, *args) -> Query:
    def run(spark, folder):
        lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        price = F.col("l_extendedprice")
        lines = lines.withColumn("price", price)
        binned = transform_feature(lines, "price", action, args)
        value = rounded("price", 4) if action != "make_named_bins" else F.col("price")
        return binned.select("l_orderkey", "l_linenumber", "l_partkey", price, value.alias("price"))

    return run


# ---- ingest and joins -----------------------------------------------------

def lang_metadata(spark, folder):
    english = filters.equals(table(spark, folder, "documents"), "lang", "en")
    return ingest.split_text(english, "doc_id", "text", drop=("lang",))[0]


def lang_text(spark, folder):
    english = filters.equals(table(spark, folder, "documents"), "lang", "en")
    return ingest.split_text(english, "doc_id", "text")[1].select("doc_id", F.md5("text").alias("digest"))


def lang_split_semi_join(spark, folder):
    text = filters.equals(table(spark, folder, "documents"), "lang", "en")
    return joins.keep_known(table(spark, folder, "labels"), text, "doc_id")


def union_chunks(spark, folder):
    """Four chunks of the documents, dealt by id hash, put together again."""
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    return files.union_chunks([documents.where(chunk == i) for i in range(4)])


#: Text bytes of a landed CSV file, about; a task that writes one reads as many.
LANDED_BYTES = 64 << 20


def landed(df: DataFrame, text_col: str, path: str) -> None:
    """Rows written as CSV files, four at least and as many as their text needs; rows of one key may lie in several."""
    (size,) = df.agg(F.sum(F.octet_length(text_col))).first()
    writer = df.repartition(max(4, (size or 0) // LANDED_BYTES)).write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("quoteAll", True).csv(path)


def land_csv(spark, folder) -> str:
    """Documents written as CSV files into a fresh folder."""
    base = scratch_path(spark, "csv-ingest")
    landed(table(spark, folder, "documents"), "text", f"{base}/landing")
    return base


def digests(spark, metadata: str, text: str) -> DataFrame:
    joined = files.scan_parquet(spark, metadata).join(files.scan_parquet(spark, text), "doc_id")
    return joined.select("doc_id", "n_chars", F.md5("text").alias("digest"))


def incremental_ingest(spark, folder):
    """Documents as arriving CSV files, split by a stream that takes what is new and stops."""
    base = land_csv(spark, folder)
    types = {"doc_id": "bigint", "text": "string", "lang": "string", "n_chars": "bigint"}
    stream = stream_csv(spark, f"{base}/landing", table(spark, folder, "documents").columns, types)
    ingest_new_files(stream, "lang", "en", "doc_id", "text", f"{base}/out", f"{base}/state")
    return digests(spark, f"{base}/out/metadata", f"{base}/out/text")


def csv_ingest(spark, folder):
    """Documents through CSV: land, scan with pruning and types, filter, split, save, read back."""
    base = land_csv(spark, folder)
    columns = {"doc_id": "bigint", "text": "string", "lang": "string", "n_chars": "bigint"}
    english = filters.equals(files.scan_csv(spark, f"{base}/landing", columns), "lang", "en")
    metadata, text = ingest.split_text(english, "doc_id", "text", drop=("lang",))
    files.save_parquet(metadata, f"{base}/metadata")
    files.append_parquet(text, f"{base}/text")
    return digests(spark, f"{base}/metadata", f"{base}/text")


def csv_ranges_ingest(spark, folder):
    """Documents landed as few CSV files with line breaks in quotes, parsed by byte ranges, some hundred or as many as 64 MB each need."""
    base = land_csv(spark, folder)
    (size,) = table(spark, folder, "documents").agg(F.sum(F.octet_length("text"))).first()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(LANDED_BYTES, max(1 << 16, (size or 0) // 200))))
    try:
        columns = {"doc_id": "bigint", "text": "string", "source": "string", "n_chars": "bigint"}
        parsed = staged(files.scan_csv(spark, f"{base}/landing", columns), "csv-parsed")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return parsed.select("doc_id", "source", "n_chars", F.md5("text").alias("digest"))


def ingest_music(spark, folder):
    """Documents landed in the raw music layout and taken up by the real ingest."""
    base = scratch_path(spark, "music-ingest")
    songs = table(spark, folder, "documents").select(
        F.col("source").alias("title"), F.lit("pop").alias("tag"), F.lit("a, b").alias("artist"), F.lit("1999.0").alias("year"),
        F.col("n_chars").alias("views"), F.lit("{}").alias("features"), F.col("text").alias("lyrics"), F.col("doc_id").alias("id"), F.col("lang").alias("language_cld3"),
    )
    landed(songs, "lyrics", f"{base}/landing")
    ingest.ingest_music(spark, f"{base}/landing", f"{base}/metadata", f"{base}/text")
    joined = files.scan_parquet(spark, f"{base}/metadata").join(files.scan_parquet(spark, f"{base}/text"), "id")
    return joined.select("id", "title", "year", "views", F.md5("lyrics").alias("digest"))


def ingest_movies(spark, folder):
    """Documents landed in the raw movie layout and taken up by the real ingest."""
    base = scratch_path(spark, "movie-ingest")
    own = {"id": F.col("doc_id"), "title": F.col("source"), "original_language": F.col("lang"), "overview": F.col("text"), "vote_count": F.col("n_chars")}
    filler = {"string": F.lit("x"), "bigint": F.lit(1), "double": F.lit("2.5")}
    movies = table(spark, folder, "documents").select(*[own.get(c, filler[k]).alias(c) for c, k in ingest.MOVIE_COLUMNS.items()])
    landed(movies, "overview", f"{base}/landing")
    ingest.ingest_movies(spark, f"{base}/landing", f"{base}/metadata", f"{base}/text")
    joined = files.scan_parquet(spark, f"{base}/metadata").join(files.scan_parquet(spark, f"{base}/text"), "id")
    return joined.select("id", "title", "vote_count", "popularity", F.md5("overview").alias("digest"))


# ---- text -----------------------------------------------------------------

def ascii_documents(spark, folder):
    return filters.ascii_only(files.spread_scan(table(spark, folder, "documents")), "text")


def ascii_filter(spark, folder):
    return table(spark, folder, "documents").select("doc_id", is_ascii("text").alias("ascii")).where("ascii")


def raw_counts(spark, folder):
    words = terms.explode_words(ascii_documents(spark, folder), "doc_id", "text")
    return terms.count_terms(terms.drop_stop_words(words))


def stemmed_counts(spark, folder):
    return terms.bag_of_words(ascii_documents(spark, folder), "doc_id", "text")


def stem_vocabulary(spark, folder):
    return terms.stem_words(raw_counts(spark, folder).select("term").distinct(), "term")


def term_totals(spark, folder):
    return terms.term_totals(raw_counts(spark, folder))


def lemma_counts(spark, folder):
    counts = staged(raw_counts(spark, folder))
    plural = counts.select("term").distinct().where(F.col("term").endswith("s"))
    lemmas = plural.withColumn("mapped", F.left("term", F.length("term") - 1))
    return terms.map_terms(counts, lemmas)


def lemmatised(part: str) -> Query:
    """Counts by dictionary form; the dictionary holds the words of several documents, words in -en are made exceptions."""

    def run(spark, folder):
        counts = staged(raw_counts(spark, folder))
        dictionary = counts.groupBy(F.col("term").alias("form")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        cut = F.left("term", F.length("term") - 2)
        exceptions = counts.select("term").distinct().where(F.col("term").endswith("en")).select("term", cut.alias("mapped"))
        return lemmas.lemmatise(counts, dictionary, exceptions, part)

    return run


def rare_term_prune(spark, folder):
    return terms.prune_rare_terms(staged(raw_counts(spark, folder)))


def bag_join_label(spark, folder):
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "id")
    return joins.attach_label(raw_counts(spark, folder), labels, "id", "quality")


def source_labels(spark, folder):
    return ascii_documents(spark, folder).select(F.col("doc_id").alias("id"), F.col("source").alias("label"))


def quality_labels(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return joins.keep_known(labels, source_labels(spark, folder), "id")


def source_information(spark, folder):
    scores = mutual_information(staged(raw_counts(spark, folder)), source_labels(spark, folder))
    return scores.select("term", rounded("mi", 8).alias("mi"))


def mutual_information_topk(spark, folder):
    scores = mutual_information(staged(raw_counts(spark, folder)), quality_labels(spark, folder))
    return select_terms(scores, 200).select("term", rounded("mi", 8).alias("mi"))


def neighbour_scores(spark, folder):
    scores = neighbour_information(staged(raw_counts(spark, folder)), quality_labels(spark, folder))
    return scores.select("term", rounded("mi", 8).alias("mi"))


# ---- sampling (by the hash that SQL can repeat) ---------------------------

def sample_n(spark, folder):
    documents = table(spark, folder, "documents")
    return sampling.sample_rows(documents, 150, "doc_id", hashed_by=portable_hash).select("doc_id", "lang")


def split_80_20(spark, folder):
    split = sampling.train_test_split(table(spark, folder, "orders"), "o_orderkey", hashed_by=portable_hash)
    return split.select("o_orderkey", "is_test")


def stratified_folds(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return sampling.stratified_folds(events, "event_id", "event_type", hashed_by=portable_hash)


# ---- models and scores ----------------------------------------------------

def nb_predictions(spark, folder):
    """Source of the held-out documents as told by naive Bayes on the others."""
    labels = staged(source_labels(spark, folder), "labels")
    labels = staged(sampling.train_test_split(labels, "id", hashed_by=portable_hash), "labels")
    counts = staged(raw_counts(spark, folder))
    model = naive_bayes.fit(counts, labels.where(~F.col("is_test")).select("id", "label"))
    return naive_bayes.predict(model, counts, labels.where("is_test")).join(labels.select("id", "label"), "id")


def nb_predict(spark, folder):
    return nb_predictions(spark, folder).select("id", "prediction", rounded("score").alias("score"))


def score_intervals(spark, folder):
    limits = metrics.score_intervals(staged(nb_predictions(spark, folder).select("id", "label", "prediction")), "id", hashed_by=portable_hash)
    return limits.select("metric", *[rounded(c).alias(c) for c in ("value", "low", "high")])


def nb_confusion(spark, folder):
    return metrics.confusion(nb_predictions(spark, folder))


def nb_class_scores(spark, folder):
    scores = metrics.class_scores(nb_predictions(spark, folder))
    return scores.select(
        "class", "support", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")]
    )


def nb_accuracy_f1(spark, folder):
    scores = metrics.accuracy_and_f1(nb_predictions(spark, folder))
    return scores.select(rounded("accuracy").alias("accuracy"), rounded("f1").alias("f1"))


def majority_baseline(spark, folder):
    share = metrics.majority_baseline(table(spark, folder, "labels"), "quality")
    return share.select("label", rounded("share").alias("share"))


def class_distribution(spark, folder):
    return metrics.class_distribution(table(spark, folder, "documents"), "source")


def quality_experiment(spark, folder) -> GenreClassifier:
    return GenreClassifier(
        files.spread_scan(table(spark, folder, "documents")), table(spark, folder, "labels"), "text", "quality",
        id_col="doc_id",
    )


def quality_vectors(spark, folder):
    prepared = quality_experiment(spark, folder).prepare(spark)
    vectors = models.vectorize(prepared.documents, prepared.counts, prepared.terms)
    vectors = staged(models.index_labels(prepared.documents, "label").transform(vectors))
    return vectors.where(~F.col("is_test")).drop("is_test"), vectors.where("is_test")


def grid(estimator: Callable, points: dict) -> Query:
    def run(spark, folder):
        train, test = quality_vectors(spark, folder)
        return models.grid_search(estimator(), points, train).transform(test).select("id", "label", "prediction")

    return run


def soft_vote(spark, folder):
    train, test = quality_vectors(spark, folder)
    return models.soft_vote(train).transform(test).select("id", "label", "prediction", "probability")


def quality_rows(spark, folder):
    """Term counts of the labelled documents as sparse rows, and how many terms there are."""
    counts = staged(raw_counts(spark, folder))
    documents = quality_labels(spark, folder).where(F.col("label").isNotNull())
    numbered = models.number_terms(joins.lookup_join(counts, documents.select("id"), "id", "left_semi"))
    return trees.sparse_rows(documents.withColumn("label_index", F.col("label").cast("int")), counts, numbered), numbered


def tree_root_splits(spark, folder):
    """The first split of a tree by either impurity, found over all tasks whatever the size."""
    rows, numbered = quality_rows(spark, folder)
    kinds = {0: "gini", 1: "entropy"}
    nodes = trees.grow(rows, [trees.Tree(n, i, depths=(1,)) for n, i in kinds.items()], 2, numbered.count(), task_doubles=0).nodes
    root = nodes.where((F.col("depth") == 0) & F.col("number").isNotNull())
    left = nodes.select("tree", F.col("node").alias("left"), (F.col("counts")[0] + F.col("counts")[1]).alias("below"))
    split = root.join(left, ["tree", "left"]).join(numbered, "number")
    return split.select(F.when(F.col("tree") == 0, "gini").otherwise("entropy").alias("impurity"), "term", "threshold", "below")


def tree_grid_results(spark, folder):
    """Every point of the tree grid, each with its score in every fold."""
    rows, numbered = quality_rows(spark, folder)
    points = {"impurity": ["entropy", "gini"], "features": ["sqrt", "log2"], "depth": [5, 10, 15]}
    return trees.grid_results(rows, points, 2, numbered.count())


def deep_forest(spark, folder):
    """Held-out documents as told by trees that grow until their leaves are pure."""
    rows, numbered = quality_rows(spark, folder)
    rows = sampling.train_test_split(rows, "id")
    told = trees.forest(rows.withColumn("label_index", F.when(~F.col("is_test"), F.col("label_index"))), 2, numbered.count(), models.FOREST_TREES)
    return told.join(rows.select("id", "label"), "id").select("id", "label", "prediction", "probability")


def ovr_optimum(spark, folder):
    """The gradient at the fitted one-vs-rest weights, from term counts: zero at the best weights, as each class's problem is convex."""
    prepared = quality_experiment(spark, folder).prepare(spark)
    indexer = models.index_labels(prepared.documents, "label")
    documents = staged(indexer.transform(prepared.documents).drop("is_test"))
    weights = one_vs_rest.fit(models.vectorize(documents, prepared.counts, prepared.terms)).weights
    rows = [(c, i, float(w)) for c, own in enumerate(weights) for i, w in enumerate(own)]
    weights = spark.createDataFrame(rows, "c int, number int, w double")
    constant = prepared.terms.count()
    cells = joins.lookup_join(joins.lookup_join(prepared.counts, prepared.terms, "term", settled=True), documents.select("id"), "id", settled=True)
    cells = cells.select("id", "number", F.col("cnt").cast("double").alias("x"))
    cells = staged(cells.unionByName(documents.select("id", F.lit(constant).alias("number"), F.lit(1.0).alias("x"))))
    met = cells.join(F.broadcast(weights), "number")
    margins = met.groupBy("id", "c").agg(F.sum(F.col("x") * F.col("w")).alias("z")).join(documents, "id")
    factor = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z"))) - (F.col("label_index") == F.col("c")).cast("double")
    sums = met.join(margins.select("id", "c", factor.alias("f")), ["id", "c"]).groupBy("c", "number").agg(F.sum(F.col("x") * F.col("f")).alias("g"))
    slope = weights.join(sums, ["c", "number"], "left").groupBy("c").agg(F.max(F.abs(F.coalesce("g", F.lit(0.0)) + F.col("w"))).alias("gradient"))
    sizes = documents.groupBy("label", F.col("label_index").cast("int").alias("c")).agg(F.count(F.lit(1)).alias("documents"))
    return sizes.join(slope, "c").select("label", "documents", rounded("gradient", 5).alias("gradient"))


def experiment_scores(spark, folder):
    return quality_experiment(spark, folder).train(spark)["scores"]


# ---- profiles -------------------------------------------------------------

def kde_curve(spark, folder):
    curve = profile.make_density_plot(table(spark, folder, "orders"), "o_totalprice")
    return curve.select(rounded("x", 4).alias("x"), rounded("density", 14).alias("density"))


def box_stats(spark, folder):
    box = profile.make_boxplot(table(spark, folder, "events"), "value")
    return box.select(*[rounded(c).alias(c) for c in box.columns if c != "outliers"], "outliers")


def category_counts(spark, folder):
    return count_categories(table(spark, folder, "events"), "event_type")


def ordered_bars(spark, folder):
    return profile.make_barplot(
        table(spark, folder, "events"), "event_type", "kind", ["view", "click", "purchase", "refund"]
    )


def top_category_counts(spark, folder):
    return top_categories(table(spark, folder, "part"), "p_brand", 10)


def word_counts(spark, folder):
    return profile.make_word_cloud(files.spread_scan(table(spark, folder, "documents")), "text")


def word_phrases(spark, folder):
    return phrases.word_phrases(files.spread_scan(table(spark, folder, "documents")), "text")


def summary_stats(spark, folder):
    stats = profile.get_summary_stats(table(spark, folder, "lineitem"), "l_quantity")
    return stats.select(*[rounded(c).alias(c) for c in stats.columns])


def price_quantiles(spark, folder):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    lines = table(spark, folder, "lineitem")
    values = quantiles(lines, "l_extendedprice", shares)
    return spark.createDataFrame(list(zip(shares, values)), "share double, value double").select(
        "share", rounded("value", 4).alias("value")
    )


# ---- ARFF -----------------------------------------------------------------

PART_ARFF = arff.ArffConfig.parse(
    {
        "relation": "PART DATA",
        "attributes": {
            "p partkey": "string", "p_brand": "nominal", "p_type": "nominal", "p_size": "nominal",
            "retail 'price'": "numeric",
        },
    }
)


def arff_parts(spark, folder):
    return table(spark, folder, "part").withColumnsRenamed({"p_partkey": "p partkey", "p_retailprice": "retail 'price'"})


def arff_body(spark, folder):
    return arff.arff_body(arff_parts(spark, folder), PART_ARFF)


def arff_header(spark, folder):
    return arff.arff_header(arff_parts(spark, folder), PART_ARFF)


def arff_header_lines(spark, folder):
    return arff.header_lines(arff_parts(spark, folder), PART_ARFF)


def arff_round_trip(spark, folder):
    """Parts written as ARFF and read back with the header's types and domains."""
    path = scratch_path(spark, "arff")
    arff.dataframe_as_arff(arff_parts(spark, folder), PART_ARFF, path, missing="?")
    return arff.scan_arff(spark, path)


# ---- configured preparation ----------------------------------------------

LINE_CONFIG = {
    "attributes": {
        "l_orderkey": {"type": "nominal"},
        "l_quantity": {"type": "real", "missing_values": [1, 2]},
        "l_discount": {"type": "real", "missing_values": [0]},
        "l_tax": {"type": "real"},
        "l_extendedprice": {"type": "real", "rename": "price"},
        "l_returnflag": {"type": "nominal", "missing_values": ["R"]},
        "l_linestatus": {"type": "nominal"},
    },
    "cleaning": [
        {"attribute": "l_quantity", "missing_strategy": "replace_missing_with_mean"},
        {"attribute": "l_discount", "missing_strategy": "replace_missing_with_value", "args": [0]},
        {"attribute": "l_returnflag", "missing_strategy": "remove"},
    ],
    "transforming": [
        {"attribute": "l_quantity", "action": "z_score_norm"},
        {"attribute": "l_tax", "action": "min_max_norm"},
        {"attribute": "price", "action": "make_mean_bins", "args": ["freq", 7]},
        {"attribute": "l_linestatus", "action": "merge_uncommon", "kwargs": {"max_categories": 1}},
    ],
    "plotting": [
        {"attribute": "price", "action": "make_barplot", "name": "PriceBars"},
        {"attribute": "l_quantity", "action": "make_boxplot", "name": "QuantityBox"},
    ],
}


def prepare_lineitem(spark, folder):
    """The configured chain: declared types, sentinels, renames, cleaning, transforms."""
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_linenumber", *LINE_CONFIG["attributes"]
    )
    prepared = prepare(spark, LINE_CONFIG, lines)
    places = {"l_quantity": 5, "l_tax": 5, "l_discount": 5, "price": 3}
    return prepared.select(
        *[rounded(F.col(c).cast("double"), places[c]).alias(c) if c in places else c for c in prepared.columns]
    )


def queries() -> dict[str, Query]:
    low_high = ["lowest", "low", "middle", "high", "highest"]
    return {
        "blank_sentinels": blanked,
        "fill_value": fill("replace_missing_with_value", 0),
        "fill_mean": fill("replace_missing_with_mean"),
        "fill_median": fill("replace_missing_with_median"),
        "fill_mode": fill_mode,
        "drop_missing": drop_missing,
        "not_equal_keep_null": not_equal_keep_null,
        "equal_filter": equal_filter,
        "range_filter": range_filter,
        "quantile_filter": quantile_filter,
        "dedup_keep_first": dedup_keep_first,
        "rename_columns": rename_columns,
        "declared_types": declared_types,
        "year_repair": year_repair,
        "nonnull_count": nonnull_counts,
        "split_columns": split_columns,
        "quoted_tokens": quoted_token_columns,
        "books_shape": books_shape,
        "movies_shape": movies_shape,
        "music_shape": music_shape,
        "z_score": transform("customer", "c_custkey", "c_acctbal", "z_score_norm"),
        "min_max": transform("part", "p_partkey", "p_retailprice", "min_max_norm"),
        "bins_freq_mean": line_bins("make_mean_bins", "freq", 7),
        "bins_freq_median": line_bins("make_median_bins", "freq", 7),
        "bins_freq_min": line_bins("make_min_bins", "freq", 7),
        "bins_freq_max": line_bins("make_max_bins", "freq", 7),
        "bins_freq_named": line_bins("make_named_bins", "freq", low_high),
        "bins_width_mean": transform("orders", "o_orderkey", "o_totalprice", "make_mean_bins", "width", 7),
        "bins_width_median": transform("orders", "o_orderkey", "o_totalprice", "make_median_bins", "width", 7),
        "bins_width_min": transform("orders", "o_orderkey", "o_totalprice", "make_min_bins", "width", 7),
        "bins_width_max": transform("orders", "o_orderkey", "o_totalprice", "make_max_bins", "width", 7),
        "bins_width_named": transform("orders", "o_orderkey", "o_totalprice", "make_named_bins", "width", low_high),
        "bins_freq_ties": transform("part", "p_partkey", "p_size", "make_mean_bins", "freq", 6),
        "merge_uncommon_topk": transform("part", "p_partkey", "p_brand", "merge_uncommon", max_categories=5),
        "merge_uncommon_count": transform("events", "event_id", "event_type", "merge_uncommon", "RARE", min_count=2000),
        "merge_uncommon_pct": transform("part", "p_partkey", "p_brand", "merge_uncommon", "RARE", min_pct=0.04),
        "lang_metadata": lang_metadata,
        "lang_text": lang_text,
        "lang_split_semi_join": lang_split_semi_join,
        "csv_ingest": csv_ingest,
        "csv_ranges_ingest": csv_ranges_ingest,
        "incremental_ingest": incremental_ingest,
        "ingest_music": ingest_music,
        "ingest_movies": ingest_movies,
        "union_chunks": union_chunks,
        "ascii_filter": ascii_filter,
        "term_counts": raw_counts,
        "stem_vocabulary": stem_vocabulary,
        "stemmed_counts": stemmed_counts,
        "lemma_counts": lemma_counts,
        "lemmatised_nouns": lemmatised("noun"),
        "lemmatised_verbs": lemmatised("verb"),
        "term_totals": term_totals,
        "rare_term_prune": rare_term_prune,
        "bag_join_label": bag_join_label,
        "source_information": source_information,
        "mutual_information_topk": mutual_information_topk,
        "neighbour_information": neighbour_scores,
        "sample_n": sample_n,
        "split_80_20": split_80_20,
        "stratified_folds": stratified_folds,
        "nb_predict": nb_predict,
        "confusion": nb_confusion,
        "class_scores": nb_class_scores,
        "accuracy_f1": nb_accuracy_f1,
        "majority_baseline": majority_baseline,
        "class_distribution": class_distribution,
        "dt_grid": grid(models.decision_tree, models.TREE_GRID),
        "rf_grid": grid(models.random_forest, models.FOREST_GRID),
        "soft_vote": soft_vote,
        "tree_root_splits": tree_root_splits,
        "tree_grid_results": tree_grid_results,
        "deep_forest": deep_forest,
        "ovr_optimum": ovr_optimum,
        "experiment_scores": experiment_scores,
        "kde_curve": kde_curve,
        "box_stats": box_stats,
        "category_counts": category_counts,
        "ordered_bars": ordered_bars,
        "top_categories": top_category_counts,
        "word_counts": word_counts,
        "word_phrases": word_phrases,
        "score_intervals": score_intervals,
        "summary_stats": summary_stats,
        "quantiles": price_quantiles,
        "arff_body": arff_body,
        "arff_header": arff_header,
        "arff_header_lines": arff_header_lines,
        "arff_round_trip": arff_round_trip,
        "prepare_lineitem": prepare_lineitem,
    }
