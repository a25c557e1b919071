"""Queries over the given tables, one per operator.

Every query reads whole tables and whole texts.  Floats are rounded so that the
order of summation does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.labels import decode_label, encode_label
from statloom.functions.text import blank_separated
from statloom.functions.vectors import bitmap_distance, squared_distance
from statloom.operators import evaluate, hamming, impurity, naive_bayes, perceptron, scaling, tree, words
from statloom.operators.evaluate import error_rate, misclassified_rows
from statloom.operators.neighbors import neighbors
from statloom.operators.split import counted_holdout, drawn, labelled_union, positional_holdout
from statloom.partitioning import spread
from statloom.plans import documents as document_plans
from statloom.plans import points
from statloom.plans.trees import stored_tree, tree_of_file
from statloom.sources.feeds import paired_feeds
from statloom.sources.files import labelled_folders, numeric_rows, with_bitmap, write_delimited
from statloom.storage import materialize, new_path
from statloom.streaming.folders import gather, gathered, labelled_stream, manifest
from statloom.streaming.scoring import document_stream, score_stream, scored_documents

TEST_SHARE = 0.2
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TREE_FEATURES = ["lang", "length", "source", "toxic"]
EPOCHS = 5
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PART_FEATURES = ["p_size", "p_retailprice"]
BITMAP_WIDTH = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def labelled(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """Documents that have labels; joined before any text is taken apart."""
    labels = table(spark, folder, "labels")
    return documents(spark, folder).join(labels, "doc_id").withColumn("label", F.col(label))


def toxic_split(spark: SparkSession, folder: str) -> DataFrame:
    split = labelled(spark, folder, "toxic").select("doc_id", "text", "label")
    return split.withColumn("is_test", drawn("doc_id", TEST_SHARE))


# Words ----------------------------------------------------------------------


def tokenize_counts(spark, folder):
    return words.word_counts(documents(spark, folder))


def whitespace_token_counts(spark, folder):
    turns = table(spark, folder, "conversations")
    pieces = turns.select(F.explode(blank_separated("text")).alias("token"))
    return pieces.groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(spark, folder):
    return words.vocabulary(documents(spark, folder))


def _label_vocabulary(spark, folder) -> DataFrame:
    counts = words.word_counts(labelled(spark, folder, "toxic"))
    return materialize(counts, "vocabulary")


def set_of_words(spark, folder):
    rows = words.set_of_words(documents(spark, folder))
    return words.in_vocabulary(rows, _label_vocabulary(spark, folder))


def bag_of_words(spark, folder):
    # Words are added up by document: a text is smaller than its rows of words.  Tasks stay as small as those of the scan.
    docs = table(spark, folder, "documents")
    tasks = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    rows = words.bag_of_words(docs.repartition(tasks, "doc_id"))
    return words.in_vocabulary(rows, _label_vocabulary(spark, folder))


def oov_words(spark, folder):
    known = words.vocabulary(labelled(spark, folder, "toxic"))
    return words.out_of_vocabulary(table(spark, folder, "benchmark"), known)


def top_words_30(spark, folder):
    return words.top_words(words.word_counts(labelled(spark, folder, "toxic")), 30)


def vocab_without_top30(spark, folder):
    counts = _label_vocabulary(spark, folder)
    return words.without_words(counts, words.top_words(counts, 30)).select("word")


# Naive Bayes ----------------------------------------------------------------


def _word_model(model: naive_bayes.NaiveBayesModel) -> DataFrame:
    return rounded(model.words, 6, "log_p1", "log_p0")


def nb_train(spark, folder):
    return _word_model(naive_bayes.train(toxic_split(spark, folder)))


def nb_train_set(spark, folder):
    return _word_model(naive_bayes.train(toxic_split(spark, folder), bag=False))


def nb_train_vocab(spark, folder):
    return _word_model(naive_bayes.train(toxic_split(spark, folder), denominator="vocab"))


def nb_prior(spark, folder):
    return rounded(naive_bayes.train(toxic_split(spark, folder)).prior, 6, "p1")


def _toxic_scores(spark, folder) -> DataFrame:
    split = toxic_split(spark, folder)
    model = naive_bayes.train(split)
    return naive_bayes.score(split.where("is_test"), model, keep=("label",))


def nb_train_merged(spark, folder):
    """Trained as documents arrive: three batches, each merged into the statistics saved before."""
    split, path = toxic_split(spark, folder), new_path(spark, "nb-statistics")
    for batch in range(3):
        part = split.where(F.pmod("doc_id", F.lit(3)) == batch)
        known = naive_bayes.statistics(part, batch=batch).add_to(path)
    return _word_model(naive_bayes.from_statistics(known))


def nb_score(spark, folder):
    return rounded(_toxic_scores(spark, folder), 4, "score1", "score0")


def nb_error_rate(spark, folder):
    return rounded(error_rate(_toxic_scores(spark, folder)), 6, "error_rate")


def nb_errors(spark, folder):
    return misclassified_rows(_toxic_scores(spark, folder)).select("doc_id", "label", "predicted")


def confusion(spark, folder):
    return evaluate.confusion(_toxic_scores(spark, folder))


def nb_save_load(spark, folder):
    split = toxic_split(spark, folder)
    path = new_path(spark, "nb-model")
    naive_bayes.train(split).save(path)
    model = naive_bayes.NaiveBayesModel.load(spark, path)
    scored = naive_bayes.score(split.where("is_test"), model, keep=("label",))
    return rounded(scored, 4, "score1", "score0")


def nb_entries(spark, folder):
    train = labelled(spark, folder, "toxic").select("doc_id", "text", "label")
    scored = document_plans.classify_documents(train, table(spark, folder, "benchmark"), "item_id")
    return rounded(scored, 4, "score1", "score0")


def nb_counted_holdout(spark, folder):
    mails = labelled(spark, folder, "toxic").select("doc_id", "text", "label")
    return rounded(document_plans.spam_evaluation(mails).report, 6, "error_rate")


def text_corpus(spark, folder):
    """Write benchmark items as one file each in two label folders, and read the folders."""
    path = new_path(spark, "corpus")
    items = table(spark, folder, "benchmark").select("item_id", "text", (F.col("item_id") % 2).alias("label"))
    items.repartition("item_id").write.partitionBy("label", "item_id").text(path)
    files = labelled_folders(spark, f"{path}/label=1", f"{path}/label=0")
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint")
    return files.select(item.alias("item_id"), "label", F.regexp_replace("text", r"\n$", "").alias("text"))


def text_corpus_arriving(spark, folder):
    """As above with the items arriving in two deliveries; the second start has lost its checkpoint, the third finds nothing new."""
    path, out = new_path(spark, "corpus"), new_path(spark, "gathered")
    items = table(spark, folder, "benchmark").select("item_id", "text", (F.col("item_id") % 2).alias("label"))
    late = F.pmod(F.xxhash64("item_id"), F.lit(2)) == 1
    for part in (~late, late, None):
        if part is not None:
            items.where(part).repartition("item_id").write.mode("append").partitionBy("label", "item_id").text(path)
        arriving = labelled_stream(spark, f"{path}/label=1/*", f"{path}/label=0/*")
        gather(arriving, out, new_path(spark, "gathered-checkpoint")).awaitTermination()
    files = gathered(spark, out, "path STRING, text STRING, label INT").withColumn("text", F.regexp_replace("text", r"\n$", ""))
    read = manifest(spark, out).select("path", "size")
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint")
    return files.join(read, "path").select(item.alias("item_id"), "label", "text", (F.col("size") - 1).alias("size"))


def paired_feed_rows(spark, folder):
    feeds = paired_feeds(documents(spark, folder), "src0", "src1")
    return feeds.select("doc_id", "source", "label")


def _local_words(spark, folder) -> document_plans.Evaluation:
    docs = documents(spark, folder).select("doc_id", "source", "text")
    return document_plans.feed_evaluation(docs, "src0", "src1")


def local_words_model(spark, folder):
    return _word_model(_local_words(spark, folder).model)


def local_words_error_rate(spark, folder):
    return rounded(_local_words(spark, folder).report, 6, "error_rate")


def local_top_words(spark, folder):
    return rounded(naive_bayes.telling_words(_local_words(spark, folder).model), 6, "log_p")


def nb_stream_score(spark, folder):
    model = naive_bayes.train(toxic_split(spark, folder))
    schema = table(spark, folder, "documents").schema
    out, checkpoint = new_path(spark, "scored"), new_path(spark, "scored-checkpoint")
    # The table may be a file or a folder of files.
    arriving = document_stream(spark, f"{folder}/documents*.parquet", schema, "*")
    query = score_stream(arriving, model, out, checkpoint)
    query.awaitTermination()
    scores = scored_documents(
        spark, out, "doc_id BIGINT, score1 DOUBLE, score0 DOUBLE, predicted INT, batch_id INT"
    )
    return rounded(scores.drop("batch_id"), 4, "score1", "score0")


def nb_stream_score_once(spark, folder):
    """As above with every document delivered in two files, one of them in a later batch: a batch for each delivery."""
    model = naive_bayes.train(toxic_split(spark, folder))
    docs, arriving = table(spark, folder, "documents"), new_path(spark, "arriving")
    for name in ("early", "late"):
        docs.write.parquet(f"{arriving}/{name}")
    # Files come in order of time, so a batch of as many as the first delivery has is that delivery.
    early = len(spark.read.schema(docs.schema).parquet(f"{arriving}/early").inputFiles())
    stream = document_stream(spark, f"{arriving}/*", docs.schema, files_per_batch=early)
    out = new_path(spark, "scored")
    score_stream(stream, model, out, new_path(spark, "scored-checkpoint"), once=("arrived", "1 day")).awaitTermination()
    scores = scored_documents(spark, out, "doc_id BIGINT, score1 DOUBLE, score0 DOUBLE, predicted INT, batch_id INT")
    return rounded(scores.drop("batch_id"), 4, "score1", "score0")


# Scaling, labels, splits ----------------------------------------------------


def minmax_stats(spark, folder):
    stats = scaling.minmax_stats(table(spark, folder, "lineitem"), LINE_FEATURES)
    return rounded(scaling.minmax_table(stats, LINE_FEATURES), 6, "min_value", "max_value", "range_value")


def minmax_apply(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE_FEATURES)
    stats = scaling.minmax_stats(lines, LINE_FEATURES)
    scaled = scaling.minmax_apply(spread(lines, "l_orderkey"), stats, LINE_FEATURES)
    return rounded(scaled, 6, *LINE_FEATURES)


def label_encode_decode(spark, folder):
    codes = {name: i + 1 for i, name in enumerate(PRIORITIES)}
    orders = table(spark, folder, "orders").withColumn("code", encode_label("o_orderpriority", codes))
    return orders.select("o_orderkey", "code", decode_label("code", PRIORITIES).alias("name"))


def holdout_random(spark, folder):
    docs = labelled(spark, folder, "toxic").select("doc_id", "label")
    return counted_holdout(docs, "doc_id", 20)


def holdout_fraction(spark, folder):
    return toxic_split(spark, folder).select("doc_id", "is_test")


def holdout_positional(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "label")
    return positional_holdout(rows, "vec_id", 0.5)


def union_labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return labelled_union(docs.where("source = 'src0'"), docs.where("source = 'src1'"))


# Nearest neighbours ---------------------------------------------------------


def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings")


def _leave_one_out(spark, folder, method: str) -> DataFrame:
    rows = _vectors(spark, folder)
    found = neighbors(
        rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("x")),
        rows.select(F.col("vec_id").alias("tid"), F.col("embedding").alias("x"), "label"),
        k=3,
        method=method,
        skip_same_id=True,
    )
    return found.select("qid", "tid", "label", "place", F.round(F.sqrt("d2"), 6).alias("distance"))


def knn_topk(spark, folder):
    return _leave_one_out(spark, folder, "auto")


def knn_topk_pruned(spark, folder):
    return _leave_one_out(spark, folder, "pruned")


def _vector_predictions(spark, folder) -> DataFrame:
    split = _vectors(spark, folder).withColumn("is_test", drawn("vec_id", TEST_SHARE))
    return points.predict_holdout(split, "vec_id", F.col("embedding"))


def knn_classify(spark, folder):
    return _vector_predictions(spark, folder)


def knn_error_rate(spark, folder):
    return rounded(error_rate(_vector_predictions(spark, folder)), 6, "error_rate")


def _parts(spark, folder) -> DataFrame:
    parts = table(spark, folder, "part").select("p_partkey", "p_type", *PART_FEATURES)
    codes = {name: i + 1 for i, name in enumerate(PART_TYPES)}
    return parts.withColumn("label", encode_label("p_type", codes))


def knn_scaled_error_rate(spark, folder):
    report = points.scaled_evaluation(_parts(spark, folder), PART_FEATURES, "p_partkey")
    return rounded(report, 6, "error_rate")


def knn_scaled_pruned(spark, folder):
    report = points.scaled_evaluation(_parts(spark, folder), PART_FEATURES, "p_partkey", method="pruned")
    return rounded(report, 6, "error_rate")


def knn_new_rows(spark, folder):
    split = positional_holdout(_parts(spark, folder), "p_partkey", 0.5)
    new, known = split.where("is_test"), split.where("not is_test")
    return points.classify_new(new, known, PART_FEATURES, "p_partkey", "p_partkey", "label", PART_TYPES)


def _bitmaps(spark, folder) -> DataFrame:
    """Signs of all vector entries as bitmap text in lines of 8, read back as bitmaps."""
    bits = F.array_join(F.transform("embedding", lambda v: F.when(v > 0, "1").otherwise("0")), "")
    text = F.regexp_replace(bits, f"(.{{{BITMAP_WIDTH}}})(?=.)", "$1\r\n")
    texts = _vectors(spark, folder).select("vec_id", "label", text.alias("text"))
    return with_bitmap(texts, "text", BITMAP_WIDTH)


def bitmap_vectors(spark, folder):
    bitmaps = _bitmaps(spark, folder)
    return bitmaps.select("vec_id", F.posexplode("v").alias("position", "bit"))


def bitmap_lines(spark, folder):
    return _bitmaps(spark, folder).select("vec_id", F.posexplode("rows").alias("line", "bits"))


def vector_distance(spark, folder):
    """Distance of every vector, and of its sign bitmap, to the one with the next id."""
    rows = _bitmaps(spark, folder).join(_vectors(spark, folder).select("vec_id", "embedding"), "vec_id")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "rows")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("x2"), F.col("rows").alias("rows2"))
    return rows.join(after, "vec_id").select(
        "vec_id",
        F.round(F.sqrt(squared_distance("x", "x2")), 6).alias("distance"),
        bitmap_distance("rows", "rows2").alias("bits"),
    )


def bitmap_error_rate(spark, folder):
    split = _bitmaps(spark, folder).withColumn("is_test", drawn("vec_id", TEST_SHARE))
    report = points.bitmap_evaluation(split.where("not is_test"), split.where("is_test"), "vec_id")
    return rounded(report, 6, "error_rate")


def bitmap_topk_indexed(spark, folder):
    """Nearest other bitmaps through the index of chunks."""
    split = _bitmaps(spark, folder).withColumn("is_test", drawn("vec_id", TEST_SHARE))
    queries = split.where("is_test").select(F.col("vec_id").alias("qid"), "words", "n_bits")
    known = split.where("not is_test").select(F.col("vec_id").alias("tid"), "words", "n_bits", "label")
    return hamming.neighbors(queries, known, 3, method="indexed").select("qid", "tid", "label", F.col("d").alias("bits"), "place")


# Trees ----------------------------------------------------------------------


def tree_rows(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(table(spark, folder, "labels"), "doc_id")
    length = F.least(F.floor(F.col("n_chars") / 1000), F.lit(4)).cast("string")
    return rows.select(
        "doc_id", "lang", length.alias("length"), "source", F.col("toxic").cast("string"),
        F.col("quality").cast("string").alias("label"),
    )


def entropy(spark, folder):
    return rounded(impurity.entropy(tree_rows(spark, folder)), 6, "entropy")


def _gains(spark, folder) -> DataFrame:
    return impurity.information_gain(tree_rows(spark, folder), TREE_FEATURES)


def info_gain(spark, folder):
    return rounded(_gains(spark, folder), 6, "base_entropy", "conditional_entropy", "gain")


def best_split(spark, folder):
    return rounded(impurity.best_split(_gains(spark, folder)), 6, "gain")


def split_dataset(spark, folder):
    return impurity.split_rows(tree_rows(spark, folder), "lang", "en")


def majority_label(spark, folder):
    return impurity.majority_label(table(spark, folder, "events"), "user_id", "event_type")


def _tree(spark, folder) -> DataFrame:
    return tree.train(tree_rows(spark, folder), TREE_FEATURES)


def id3_nodes(spark, folder):
    return rounded(_tree(spark, folder), 6, "gain")


def id3_classify(spark, folder):
    scored = tree.classify(tree_rows(spark, folder), _tree(spark, folder), TREE_FEATURES)
    return scored.select("doc_id", "label", "predicted")


def id3_classify_routed(spark, folder):
    scored = tree.classify(tree_rows(spark, folder), _tree(spark, folder), TREE_FEATURES, compiled_nodes=0)
    return scored.select("doc_id", "label", "predicted")


def id3_tree_stats(spark, folder):
    return tree.leaves_and_depth(_tree(spark, folder))


def tree_save_load(spark, folder):
    return rounded(stored_tree(spark, _tree(spark, folder), new_path(spark, "tree")), 6, "gain")


def delimited_tree(spark, folder):
    """Write the rows as a tab-delimited file, read it back and grow the tree."""
    path = new_path(spark, "tree-rows")
    rows = tree_rows(spark, folder).select(*TREE_FEATURES, "label")
    write_delimited(rows, path)
    schema = ", ".join(f"{c} STRING" for c in [*TREE_FEATURES, "label"])
    return rounded(tree_of_file(spark, path, schema), 6, "gain")


def delimited_numeric(spark, folder):
    """Write part features as a tab-delimited file and read it back with encoded labels."""
    path = new_path(spark, "part-rows")
    parts = table(spark, folder, "part")
    parts.select(F.concat_ws("\t", "p_partkey", "p_size", "p_retailprice", "p_type")).write.text(path)
    codes = {name: i + 1 for i, name in enumerate(PART_TYPES)}
    return numeric_rows(spark, path, ("part_key", "size", "price"), codes)


# Perceptron -----------------------------------------------------------------


def line_points(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    above = F.col("l_extendedprice") / F.col("l_quantity") > 1500
    lines = lines.withColumn("y", F.when(above, 1).otherwise(-1))
    features = ["l_quantity", "l_extendedprice"]
    scaled = scaling.minmax_apply(lines, scaling.minmax_stats(lines, features), features)
    return scaled.select("l_orderkey", "l_linenumber", F.array(*features).alias("x"), "y")


def perceptron_primal(spark, folder):
    model = perceptron.train_primal(line_points(spark, folder), EPOCHS)
    weights = [F.round(F.col("w")[j], 6).alias(f"w{j}") for j in range(2)]
    return model.select("epoch", "misclassified", *weights, F.round("b", 6).alias("b"))


def perceptron_predict(spark, folder):
    rows = line_points(spark, folder)
    plane = perceptron.last_plane(perceptron.train_primal(rows, EPOCHS))
    scored = perceptron.predict(spread(rows, "l_orderkey"), plane)
    return rounded(scored.select("l_orderkey", "l_linenumber", "score", "y", "predicted"), 6, "score")


def _vector_points(spark, folder) -> DataFrame:
    y = F.when(F.col("label") < 5, 1).otherwise(-1)
    return _vectors(spark, folder).select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("x"), y.alias("y"))


def perceptron_dual(spark, folder):
    state, _ = perceptron.train_dual(_vector_points(spark, folder), EPOCHS)
    return rounded(state.select("row_id", "y", "alpha"), 6, "alpha")


def dual_weights(spark, folder):
    rows = _vector_points(spark, folder)
    state, plane = perceptron.train_dual(rows, EPOCHS)
    total, *w = perceptron.weights_from_dual(state, len(plane.w))
    weights = [(j, float(v)) for j, v in enumerate([total, *w])]
    return rounded(spark.createDataFrame(weights, "dim INT, w DOUBLE"), 6, "w")


def gram_product(spark, folder):
    rows = _vector_points(spark, folder)
    product = perceptron.gram_product(rows, F.col("y"))
    return rounded(product.select("row_id", "product"), 6, "product")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    text_corpus, text_corpus_arriving, tokenize_counts, whitespace_token_counts, vocabulary, set_of_words, bag_of_words, oov_words,
    top_words_30, vocab_without_top30,
    nb_train, nb_train_set, nb_train_vocab, nb_train_merged, nb_prior, nb_score, nb_error_rate, nb_errors, confusion,
    nb_save_load, nb_entries, nb_counted_holdout, paired_feed_rows, local_words_model,
    local_words_error_rate, local_top_words, nb_stream_score, nb_stream_score_once,
    minmax_stats, minmax_apply, label_encode_decode, holdout_random, holdout_fraction,
    holdout_positional, union_labelled,
    knn_topk, knn_topk_pruned, knn_classify, knn_error_rate, knn_scaled_error_rate, knn_scaled_pruned,
    knn_new_rows, bitmap_vectors, bitmap_lines, vector_distance, bitmap_error_rate, bitmap_topk_indexed,
    entropy, info_gain, best_split, split_dataset, majority_label, id3_nodes, id3_classify,
    id3_classify_routed, id3_tree_stats, tree_save_load, delimited_tree, delimited_numeric,
    perceptron_primal, perceptron_predict, perceptron_dual, dual_weights, gram_product,
]
