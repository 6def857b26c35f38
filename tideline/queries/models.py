"""Queries for preprocessing, training and replay."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.evaluate import max_abs_diff
from tideline.operators.sampling import stratified_split
from tideline.plans import model_tables as T
from tideline.plans import training as N
from tideline.plans.extra_trees import ExtraTrees, ExtraTreesModel
from tideline.queries.core import CATEGORICAL, CUR, NUMERIC, current, long_sql
from tideline.queries.views import REF, reference, table
from tideline.session import cut, scratch_path, stored
from tideline.sources.versioned import read_version

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_MODES = f"""modes AS (SELECT feature, value AS text, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS rn
  FROM ({long_sql('cur', CATEGORICAL, 'VARCHAR')}) WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {CUR}, {_MODES} SELECT feature, round(quantile_cont(value, 0.5), 6) AS number, CAST(NULL AS VARCHAR) AS text FROM ({long_sql('cur', NUMERIC, 'DOUBLE')}) GROUP BY 1
UNION ALL SELECT feature, NULL, text FROM modes WHERE rn = 1""")
def imputation_values(spark: SparkSession, sf: str) -> DataFrame:
    return N.imputation_values(current(spark, sf), NUMERIC, CATEGORICAL).withColumn("number", F.round("number", 6))


@query(f"""WITH {CUR}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM cur)) AS d, l_quantity AS q FROM cur)
SELECT l_orderkey, l_linenumber, l_partkey, round((d - avg(d) OVER ()) / stddev_pop(d) OVER (), 6) AS l_discount, round((q - avg(q) OVER ()) / stddev_pop(q) OVER (), 6) AS l_quantity FROM f""")
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    rows = current(spark, sf)
    out = N.fit_preprocessor(rows, ["l_discount", "l_quantity"], []).standardize(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(c) for c in ("l_discount", "l_quantity")])


@query("""SELECT quality AS class, round((SELECT count(*) FROM labels) / (2.0::DOUBLE * count(*)), 9) AS weight FROM labels GROUP BY 1""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return N.class_weights(table(spark, sf, "labels"), "quality").withColumn("weight", F.round("weight", 9))


@query("""SELECT doc_id, CAST(CAST('0x' || substr(md5('dummy42|' || doc_id), 1, 13) AS BIGINT)::DOUBLE < (SELECT avg(quality) FROM labels) * pow(16::DOUBLE, 13) AS DOUBLE) AS probability FROM labels""")
def dummy_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels")
    return N.dummy_baseline(rows, "quality", rows, ["doc_id"]).select("doc_id", "probability")


@query(f"""WITH {REF}, {CUR}, known AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS position FROM (SELECT DISTINCT l_returnflag FROM ref))
SELECT l_returnflag, CAST(coalesce(position, 0) AS BIGINT) AS position, CAST(count(position) AS DOUBLE) AS ones, count(*) AS n FROM cur LEFT JOIN known USING (l_returnflag) GROUP BY 1, 2""")
def encoded_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of later rows in the indicators fitted on earlier ones: place of the one, and none for an unknown category."""
    encoder = N.feature_pipeline([], ["l_returnflag"]).fit(reference(spark, sf))
    rows = encoder.transform(current(spark, sf)).select("l_returnflag", vector_to_array("features").alias("x"))
    ones = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy("l_returnflag", F.array_position("x", F.lit(1.0)).alias("position")).agg(F.sum(ones).alias("ones"), F.count(F.lit(1)).alias("n"))


DOC_NUMERIC = ["n_chars", "n_lines", "n_words", "share_upper"]
DOC_CATEGORICAL = ["lang", "source"]


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with simple text features and a stratified split. Texts are read once; what follows scans the features many times."""
    text = F.col("text")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "quality", "n_chars", "lang", "source",
        F.size(F.split(text, "\n")).alias("n_lines"), F.size(F.split(text, r"\s+")).alias("n_words"),
        (F.regexp_count(text, F.lit("[A-Z]")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("share_upper"),
    )
    return stratified_split(stored(rows), "quality", ["doc_id"])


@query()
def lr_scores(spark: SparkSession, sf: str) -> DataFrame:
    builders = {"logistic_regression": N.candidates()["logistic_regression"]}
    split = labelled_documents(spark, sf)
    result = N.train(split, DOC_NUMERIC, DOC_CATEGORICAL, "quality", ["doc_id"], builders)
    return result.score(split).select("doc_id", "split", "quality", "probability")


_LABELLED = "labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL"


@query(f"""SELECT 'intercept' AS kind, CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS VARCHAR) AS category, 0.0::DOUBLE AS gradient
UNION ALL SELECT 'number', unnest(['n_chars', 'n_lines', 'n_words', 'share_upper']), NULL, 0.0
UNION ALL SELECT DISTINCT 'category', 'lang', lang, 0.0 FROM {_LABELLED} AND lang IS NOT NULL
UNION ALL SELECT DISTINCT 'category', 'source', source, 0.0 FROM {_LABELLED} AND source IS NOT NULL""")
def lr_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of a logistic regression with the gradient of its loss there, scored from the table of terms: 0 at the optimum.

    The loss is the weighted log loss plus half the squares of the coefficients (not of the intercept), for each unit of weight.
    """
    split = labelled_documents(spark, sf).withColumn("split", F.lit("train"))
    rows = split.unionByName(split.withColumn("split", F.lit("val")))
    result = N.train(rows, DOC_NUMERIC, DOC_CATEGORICAL, "quality", ["doc_id"], {"logistic_regression": N.candidates()["logistic_regression"]})
    terms = T.logistic_terms(result.model, result.encoder, result.preprocessor)
    weights = N.class_weights(split, "quality").withColumnRenamed("class", "quality")
    scored = T.score_logistic(split, terms).join(F.broadcast(weights), "quality")  # two classes
    filled, _, _ = T.logistic_features(scored, terms)
    pull = F.col("weight") * (F.col("probability") - F.col("quality"))
    filled = cut(filled.withColumn("pull", pull))
    numbers = {c: F.sum(F.col("pull") * F.col(f"x_{c}")) for c in DOC_NUMERIC}
    sums = filled.agg(F.sum("weight").alias("total"), F.sum("pull").alias("one"), *[v.alias(c) for c, v in numbers.items()])
    plain = sums.select("total", F.explode(F.array(F.struct(F.lit("intercept").alias("kind"), F.lit(None).cast("string").alias("feature"), F.col("one").alias("g")), *[F.struct(F.lit("number").alias("kind"), F.lit(c).alias("feature"), F.col(c).alias("g")) for c in numbers])).alias("r")).select("total", "r.*", F.lit(None).cast("string").alias("category"))
    found = plain
    for c in DOC_CATEGORICAL:
        each = filled.groupBy(F.col(f"x_{c}").alias("category")).agg(F.sum("pull").alias("g"))
        found = found.unionByName(each.join(F.broadcast(sums.select("total")), F.lit(True)).select("total", F.lit("category").alias("kind"), F.lit(c).alias("feature"), "g", "category"))  # one row
    mine, theirs = found.alias("m"), terms.where("kind <> 'text'").alias("t")
    same = (F.col("m.kind") == F.col("t.kind")) & F.col("m.feature").eqNullSafe(F.col("t.feature")) & F.col("m.category").eqNullSafe(F.col("t.category"))
    penalty = F.when(F.col("t.kind") == "intercept", 0.0).otherwise(F.col("t.coefficient"))
    return mine.join(theirs, same).select("m.kind", "m.feature", "m.category", F.round(F.abs((F.col("g") + penalty) / F.col("total")), 3).alias("gradient"))


@query(f"""SELECT candidate, count(*) AS scored, 0::BIGINT AS unmatched, true AS within FROM {_LABELLED.replace('documents USING (doc_id)', "documents USING (doc_id) CROSS JOIN (VALUES ('logistic_regression'), ('random_forest'), ('extra_trees')) c(candidate)")} GROUP BY 1""")
def scores_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled documents scored by each model and from the model's table: no score differs by more than 1e-12."""
    split = labelled_documents(spark, sf)
    built = N.candidates(num_trees=10, max_depth=8)
    out = None
    for name in ("logistic_regression", "random_forest", "extra_trees"):
        result = N.train(split, DOC_NUMERIC, DOC_CATEGORICAL, "quality", ["doc_id"], {name: built[name]})
        (table_,) = T.as_tables(result.model, result.encoder, result.preprocessor).values()
        if name == "logistic_regression":
            again = T.score_logistic(split, table_)
        else:
            again = N.score(ExtraTreesModel(table_, 10), result.encoder, result.preprocessor, split)
        row = max_abs_diff(result.score(split), again, ["doc_id"]).select(F.lit(name).alias("candidate"), F.col("n_rows").alias("scored"), "unmatched", "within")
        out = row if out is None else out.unionByName(row)
    return out


@query()
def train_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of all candidates of one training run."""
    return N.train(labelled_documents(spark, sf), DOC_NUMERIC, DOC_CATEGORICAL, "quality", ["doc_id"]).metrics


_PARTS = """classes AS (SELECT quality, count(*) AS n, ceil(count(*) * 0.4::DOUBLE) AS held FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1),
parts AS (SELECT CAST(sum(n - held) AS BIGINT) AS train_rows, CAST(sum(held - ceil(held * 0.5::DOUBLE)) AS BIGINT) AS val_rows, CAST(sum(ceil(held * 0.5::DOUBLE)) AS BIGINT) AS test_rows FROM classes)"""


@query(f"""WITH {_PARTS} SELECT candidate, train_rows, val_rows, test_rows, 1::BIGINT AS selected, 0::BIGINT AS version,
  (SELECT count(*) FROM part WHERE p_brand <> 'Brand#1') AS other_versions FROM parts, (VALUES ('dummy'), ('logistic_regression'), ('random_forest'), ('extra_trees')) c(candidate)""")
def retrain_job(spark: SparkSession, sf: str) -> DataFrame:
    """A retrain run with all candidates, read back from what it has published: one row for each candidate."""
    from tideline.queries.tables import versions

    path = scratch_path(spark, "registry")
    N.retrain(labelled_documents(spark, sf), DOC_NUMERIC, DOC_CATEGORICAL, "quality", ["doc_id"], versions(spark, sf), "Brand#1", registry=path)
    found = read_version(spark, path)
    others = found.table("versions").where("model <> 'Brand#1'").agg(F.count(F.lit(1)).alias("other_versions"))
    report = found.table("report")
    chosen = report.agg(F.count_if("selected").alias("selected"))
    facts = report.select("candidate", "train_rows", "val_rows", "test_rows", F.lit(found.number).cast("bigint").alias("version"))
    return facts.join(F.broadcast(chosen), F.lit(True)).join(F.broadcast(others), F.lit(True))  # one row each


@query("""WITH d AS (SELECT n_chars, quality FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)
SELECT CAST(tree AS INTEGER) AS tree, count(*) AS rows, count(*) AS rows_in_leaves, CAST(sum(quality) AS DOUBLE) AS positive_in_leaves,
  CAST(min(n_chars) AS DOUBLE) AS least_n_chars, CAST(max(n_chars) AS DOUBLE) AS most_n_chars, 0::BIGINT AS split_outside_range, 0::BIGINT AS impure_leaves_of_varying_rows
FROM d, range(10) t(tree) GROUP BY tree""")
def extra_trees_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of randomised trees grown on all labelled documents: rows reach leaves once, splits lie inside ranges, leaves are pure."""
    rows = table(spark, sf, "labels").where("quality is not null").join(table(spark, sf, "documents"), "doc_id")
    text = F.col("text")
    numbers = [F.col("n_chars").cast("double"), F.regexp_count(text, F.lit("[aeiou]")).cast("double"), F.regexp_count(text, F.lit(" ")).cast("double")]
    frame = rows.select(array_to_vector(F.array(*numbers)).alias("features"), F.col("quality").alias("label"), F.lit(1.0).alias("weight"))
    nodes = ExtraTrees(num_trees=10).fit(frame).nodes
    leaf, root = F.col("feature").isNull(), F.col("node") == 0
    outside = ~leaf & ((F.col("threshold") < F.get("low", F.col("feature"))) | (F.col("threshold") >= F.get("high", F.col("feature"))))
    impure = leaf & (F.col("positive") > 0) & (F.col("positive") < F.col("weight")) & (F.col("low") != F.col("high"))
    return nodes.groupBy("tree").agg(
        F.sum(F.when(root, F.col("n"))).alias("rows"), F.sum(F.when(leaf, F.col("n"))).alias("rows_in_leaves"), F.sum(F.when(leaf, F.col("positive"))).alias("positive_in_leaves"),
        F.max(F.when(root, F.get("low", F.lit(0)))).alias("least_n_chars"), F.max(F.when(root, F.get("high", F.lit(0)))).alias("most_n_chars"),
        F.count_if(outside).alias("split_outside_range"), F.count_if(impure).alias("impure_leaves_of_varying_rows"),
    )


@query()
def replay_job(spark: SparkSession, sf: str) -> DataFrame:
    builders = {"logistic_regression": N.candidates()["logistic_regression"]}
    split = labelled_documents(spark, sf)
    result = N.train(split, DOC_NUMERIC, DOC_CATEGORICAL, "quality", ["doc_id"], builders)
    return N.replay(result.model, result.encoder, result.preprocessor, split.where(F.col("split") == "test"), "quality", result.threshold)


