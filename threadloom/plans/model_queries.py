"""Queries of annotation runs, pooling, graph layers and classifiers, on whole vectors."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..functions import vectors as V
from ..operators import annotate, graph, graph_training, messages, metrics, minibatch, relational, sampling, training
from . import fixtures as T
from .registry import NEAREST, query

WIDTH, OUT = 64, 16


def weight(inputs: int, outputs: int, step: int) -> list[list[float]]:
    """A matrix of small multiples of 1/8, by a rule that SQL can follow."""
    return [[((i * 7 + j * 3 + step) % 11 - 5) / 8 for j in range(outputs)] for i in range(inputs)]


def weight_sql(i: str, j: str, step: int) -> str:
    return f"((({i}) * 7 + ({j}) * 3 + {step}) % 11 - 5) / 8.0::DOUBLE"


def bias(outputs: int) -> list[float]:
    return [(j % 5 - 2) / 4 for j in range(outputs)]


_BIAS = "(j % 5 - 2) / 4.0::DOUBLE"


# ---- annotation runs


def _unsteady():
    """The stand-in model, which here answers some ids with a confidence out of range and some without JSON."""
    steady = annotate.fake_backend()

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for said in steady(prompts):
            tweet, items = next(iter(json.loads(said).items()))
            items[0]["confidence"] = 1.5 if tweet.endswith("7") else 0.9
            out.append("sorry" if tweet.endswith("9") else json.dumps({tweet: items}, ensure_ascii=False))
        return out

    return answer


def _failing():
    """The stand-in model, which fails for a batch that holds an id ending in 3."""
    steady = annotate.fake_backend()

    def answer(prompts: list[str]) -> list[str]:
        if any("3\n" in p.partition("Tweet ID: ")[2][:20] for p in prompts):
            raise RuntimeError("no model")
        return steady(prompts)

    return answer


@query("votes tweets", "SELECT tweet_id, right(tweet_id, 1) <> '9' AS is_valid, CASE WHEN right(tweet_id, 1) = '9' THEN 'parse_error' END AS error, CASE WHEN right(tweet_id, 1) IN ('7', '9') THEN 0 ELSE 1 END AS n FROM tweets", ints="n")
def q_llm_batch(spark, sf_dir):
    done = annotate.run(T.tweets(spark, sf_dir), _unsteady)
    return done.select("tweet_id", "is_valid", "error", F.size("annotations").alias("n"))


@query("votes tweets", "SELECT tweet_id, right(tweet_id, 1) <> '3' AS ok, CASE WHEN right(tweet_id, 1) = '3' THEN 'no model' ELSE tweet_id END AS said FROM tweets")
def q_annotate_single(spark, sf_dir):
    """One text a call, with a second try; a failure is an outcome of the row."""
    prompts = T.tweets(spark, sf_dir).select("tweet_id", "text", F.concat(F.lit("Tweet ID: "), "tweet_id", F.lit('\nTweet Text: "'), "text", F.lit('"\n\nProvide')).alias("prompt"))
    done = annotate.annotate(prompts, _failing, batch=1, retries=2, delay=0.0)
    return done.select("tweet_id", "ok", F.when(F.col("ok"), F.json_object_keys("response")[0]).otherwise(F.col("response")).alias("said"))


@query("votes tweets", "SELECT count(*) AS requests, round(count(*) FILTER (WHERE right(tweet_id, 1) <> '3') * 100.0::DOUBLE / count(*), 6) AS success_rate, round(avg(length(tweet_id) / 10.0::DOUBLE), 6) AS mean_seconds, round(sum(length(text)) / 4.0::DOUBLE / sum(length(tweet_id) / 10.0::DOUBLE), 4) AS tokens_per_second FROM tweets")
def q_inference_stats(spark, sf_dir):
    rows = T.tweets(spark, sf_dir)
    done = rows.select(F.col("text").alias("response"), ~F.col("tweet_id").endswith("3"), (F.length("tweet_id") / 10.0).alias("seconds")).toDF("response", "ok", "seconds")
    stats = annotate.inference_stats(done)
    return stats.select("requests", "success_rate", F.round("mean_seconds", 6).alias("mean_seconds"), F.round("tokens_per_second", 4).alias("tokens_per_second"))


def _lengths():
    return lambda texts: [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


@query("", "SELECT doc_id AS id, place, CAST([length(coalesce(text, '')), length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')), 1][place + 1] AS DOUBLE) AS value FROM documents, range(3) r(place)")
def q_embed(spark, sf_dir):
    """Embeddings by a pluggable encoder, here of lengths and blanks."""
    vectors = annotate.embed(T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), _lengths)
    return vectors.select("id", F.posexplode("vector").alias("place", "v")).select("id", F.col("place").cast("long").alias("place"), F.col("v").cast("double").alias("value"))


def _first_letters():
    return lambda texts: [[ord(c) for c in t] for t in texts]


@query("votes tweets", "SELECT tweet_id AS id, unicode(text) AS first, least(length(text), 128) AS used, 128 AS width, 128 - least(length(text), 128) AS padded, taco_class AS label, 1.0::DOUBLE AS perspective FROM tweets", ints="first used width padded")
def q_collate(spark, sf_dir):
    rows = T.tweets(spark, sf_dir).select(F.col("tweet_id").alias("id"), "text", F.col("taco_class").alias("label"), F.array(F.lit(1.0)).alias("perspectives"))
    done = annotate.collate(rows, _first_letters)
    used = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    padded = F.size(F.filter(F.arrays_zip("input_ids", "attention_mask"), lambda x: (x["input_ids"] == 1) & (x["attention_mask"] == 0)))
    return done.select("id", F.col("input_ids")[0].alias("first"), used.alias("used"), F.size("input_ids").alias("width"), padded.alias("padded"), "label", F.col("perspectives")[0].alias("perspective"))


@query("votes tweets", "SELECT tweet_id, md5(regexp_replace(text, 'https?://[!$-_a-z]+', '[URL]', 'g')) AS masked, md5(text) AS kept, len(regexp_extract_all(text, 'https?://[!$-_a-z]+')) > 0 AS has_urls, len(regexp_extract_all(text, 'https?://[!$-_a-z]+')) AS url_count FROM tweets", ints="url_count")
def q_handle_urls(spark, sf_dir):
    rows = T.tweets(spark, sf_dir)
    kept = X.handle_urls(rows).select("tweet_id", F.md5("text").alias("kept"))
    return X.handle_urls(rows, keep_urls=False).withColumn("masked", F.md5("text")).drop("text").join(kept, "tweet_id")


@query("", "SELECT page_id, url AS leads, CAST(NULL AS VARCHAR) AS title, TRUE AS alive FROM pages")
def q_url_stubs(spark, sf_dir):
    url = F.col("url")
    return T.table(spark, sf_dir, "pages").select("page_id", U.resolve_url(url).alias("leads"), U.fetch_url(url)["title"].alias("title"), U.url_alive(url).alias("alive"))


# ---- pooling and losses


@query("vectors", """, w AS (SELECT label, CAST(unnest(vector) AS DOUBLE) AS v, unnest(range(64)) AS place, CASE WHEN id % 3 = 0 OR label = 1 THEN 0.0 ELSE 1.0 END AS m FROM vectors)
    SELECT label, place, round(CAST(sum(v * m) / greatest(sum(m), 1e-9) AS DOUBLE), 5) AS value FROM w GROUP BY label, place""")
def q_mean_pool(spark, sf_dir):
    """Masked means by label; one label's rows are all masked."""
    rows = T.vectors(spark, sf_dir).withColumn("mask", F.when((F.col("id") % 3 == 0) | (F.col("label") == 1), 0.0).otherwise(1.0))
    pooled = V.pooled(rows, "label", "vector", "mask").select("label", F.posexplode("vector").alias("at", "v"))
    return pooled.select("label", F.col("at").cast("long").alias("place"), F.round("v", 5).alias("value"))


@query("vectors", "SELECT label, unnest(range(64)) AS place, round(CAST(unnest(arg_min(vector, id)) AS DOUBLE), 6) AS value FROM vectors GROUP BY label")
def q_cls_pool(spark, sf_dir):
    """Of each label the first of its vectors, as tokens of one text."""
    first = T.vectors(spark, sf_dir).groupBy("label").agg(F.array(F.min_by("vector", "id")).alias("tokens"))
    rows = first.select("label", F.posexplode(V.cls_pool(F.col("tokens"))).alias("at", "v"))
    return rows.select("label", F.col("at").cast("long").alias("place"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("vectors", ", z AS (SELECT id, label, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors), g AS (SELECT id, v[label % 64 + 1] - ln(list_sum(list_transform(v, lambda x: exp(x)))) AS lp FROM z) SELECT id, round(power(1 - exp(lp), 2) * -lp, 6) AS loss FROM g")
def q_focal_loss(spark, sf_dir):
    rows = T.vectors(spark, sf_dir)
    return rows.select("id", F.round(V.focal_loss(F.col("vector").cast("array<double>"), F.col("label") % 64), 6).alias("loss"))


@query("vectors", "SELECT id, CAST(list_position(vector, list_aggregate(vector, 'max')) - 1 AS INT) AS best FROM vectors")
def q_argmax(spark, sf_dir):
    return T.vectors(spark, sf_dir).select("id", V.argmax(F.col("vector")).alias("best"))


# ---- graph layers: 64 inputs, 16 outputs


def _graph(spark, sf_dir):
    rows = T.vectors(spark, sf_dir)
    return rows.select("id", F.col("vector").cast("array<double>").alias("x")), graph.neighbour_edges(rows, 3, 0.4)


def _flat(layer, digits=5):
    rows = layer.select("id", F.posexplode("x").alias("at", "v"))
    return rows.select("id", F.col("at").cast("long").alias("place"), F.round("v", digits).alias("value"))


_IN = NEAREST + ", e AS (SELECT src, dst FROM near WHERE rank <= 3 UNION ALL SELECT dst, src FROM near WHERE rank <= 3), z AS (SELECT id, unnest(v) AS v, unnest(range(len(v))) AS i FROM n), l AS (SELECT src, dst FROM e UNION ALL SELECT id, id FROM n)"


def _product(table: str, step: int, outputs: int = OUT) -> str:
    """(id, j, h): the rows of (id, i, v) times a weight matrix."""
    return f"SELECT id, j, sum(v * {weight_sql('i', 'j', step)}) AS h FROM {table}, range({outputs}) r(j) GROUP BY id, j"


@query("vectors", _IN + f", m AS (SELECT e.dst AS id, i, avg(v) AS v FROM e JOIN z ON z.id = e.src GROUP BY 1, 2), a AS ({_product('z', 1)}), b AS ({_product('m', 2)}) SELECT a.id, a.j AS place, round(a.h + coalesce(b.h, 0) + (a.j % 5 - 2) / 4.0::DOUBLE, 5) AS value FROM a LEFT JOIN b ON a.id = b.id AND a.j = b.j")
def q_sage_mean(spark, sf_dir):
    return _flat(messages.sage(*_graph(spark, sf_dir), weight(WIDTH, OUT, 1), weight(WIDTH, OUT, 2), bias(OUT)))


_GCN = "d AS (SELECT dst AS id, count(*) AS d FROM l GROUP BY 1)"


@query("vectors", _IN + f", {_GCN}, h AS ({_product('z', 1)}) SELECT l.dst AS id, h.j AS place, round(sum(h.h / sqrt(s.d * t.d)) + (h.j % 5 - 2) / 4.0::DOUBLE, 5) AS value FROM l JOIN h ON h.id = l.src JOIN d s ON s.id = l.src JOIN d t ON t.id = l.dst GROUP BY 1, 2, h.j")
def q_gcn_layer(spark, sf_dir):
    return _flat(messages.gcn(*_graph(spark, sf_dir), weight(WIDTH, OUT, 1), bias(OUT)))


_HEADS = 2
_ATTEND = f"""h AS (SELECT id, k, j, sum(v * CASE k WHEN 0 THEN {weight_sql('i', 'j', 1)} ELSE {weight_sql('i', 'j', 2)} END) AS h FROM z, range({OUT}) r(j), range({_HEADS}) q(k) GROUP BY id, k, j),
    c AS (SELECT id, k, sum(h * {weight_sql('k', 'j', 3)}) AS s, sum(h * {weight_sql('k', 'j', 4)}) AS t FROM h GROUP BY id, k),
    w AS (SELECT l.src, l.dst, a.k, CASE WHEN a.s + b.t > 0 THEN a.s + b.t ELSE 0.2::DOUBLE * (a.s + b.t) END AS e FROM l JOIN c a ON a.id = l.src JOIN c b ON b.id = l.dst AND b.k = a.k),
    u AS (SELECT src, dst, k, exp(e - max(e) OVER (PARTITION BY dst, k)) AS w FROM w)"""


@query("vectors", _IN + f", {_ATTEND} SELECT u.dst AS id, u.k * {OUT} + h.j AS place, round(sum(u.w * h.h) / sum(u.w) + ((u.k * {OUT} + h.j) % 5 - 2) / 4.0::DOUBLE, 5) AS value FROM u JOIN h ON h.id = u.src AND h.k = u.k GROUP BY u.dst, u.k, h.j")
def q_gat_layer(spark, sf_dir):
    return _flat(messages.gat(*_graph(spark, sf_dir), [weight(WIDTH, OUT, 1), weight(WIDTH, OUT, 2)], weight(_HEADS, OUT, 3), weight(_HEADS, OUT, 4), bias(_HEADS * OUT)))


_DENSE = f"f AS (SELECT id, j AS i, greatest(h + {_BIAS}, 0) AS v FROM ({_product('z', 1)})), g AS (SELECT id, j, h + {_BIAS} AS h FROM ({_product('f', 2, 4)}))"


def _dense(inputs: int = WIDTH) -> messages.Dense:
    return messages.Dense(weight(inputs, OUT, 1), bias(OUT), weight(OUT, 4, 2), bias(4))


@query("vectors", _IN + f", {_DENSE} SELECT id, j AS place, round(h, 5) AS value FROM g")
def q_dense(spark, sf_dir):
    """The two-layer classifier applied with given weights."""
    rows = T.vectors(spark, sf_dir)
    return _flat(rows.select("id", _dense()(F.col("vector")).alias("x")))


@query("vectors", _IN + f", {_DENSE}, y AS (SELECT id, j AS i, h AS v FROM g), m AS (SELECT e.dst AS id, i, avg(v) AS v FROM e JOIN y ON y.id = e.src GROUP BY 1, 2), a AS ({_product('y', 3, 4)}), b AS ({_product('m', 4, 4)}) SELECT g.id, g.j AS place, round(g.h + a.h + coalesce(b.h, 0) + (g.j % 5 - 2) / 4.0::DOUBLE, 5) AS value FROM g JOIN a ON a.id = g.id AND a.j = g.j LEFT JOIN b ON b.id = g.id AND b.j = g.j")
def q_hybrid(spark, sf_dir):
    return _flat(messages.hybrid(*_graph(spark, sf_dir), _dense(), lambda v, e: messages.sage(v, e, weight(4, 4, 3), weight(4, 4, 4), bias(4))))


@query("vectors", _IN + f", p AS (SELECT id, i, v FROM z UNION ALL SELECT id, 64 + k, (label % (k + 2)) / 4.0::DOUBLE FROM vectors, range(6) r(k)), f AS (SELECT id, j AS i, greatest(h + {_BIAS}, 0) AS v FROM ({_product('p', 1)})) SELECT id, j AS place, round(h + {_BIAS}, 5) AS value FROM ({_product('f', 2, 4)})")
def q_fused(spark, sf_dir):
    """An embedding beside six perspective features."""
    perspectives = F.transform(F.array(*map(F.lit, range(6))), lambda k: (F.col("label") % (k + 2)) / 4.0)
    return _flat(T.vectors(spark, sf_dir).select("id", messages.fused(F.col("vector"), perspectives, _dense(WIDTH + 6)).alias("x")))


def _layer_sql(name: str, before: str, step: int) -> str:
    """CTEs of a GCN layer without bias over (id, i, v) of ``before``, normalised over the graph: (id, i, v) as ``name``."""
    return f"""{name}h AS ({_product(before, step)}), {name}r AS (SELECT l.dst AS id, h.j AS i, sum(h.h / sqrt(s.d * t.d)) AS v FROM l JOIN {name}h h ON h.id = l.src JOIN d s ON s.id = l.src JOIN d t ON t.id = l.dst GROUP BY 1, 2),
    {name} AS (SELECT id, i, (v - (SELECT avg(v) FROM {name}r)) / ((SELECT stddev_pop(v) FROM {name}r) + 1e-5::DOUBLE) AS v FROM {name}r)"""


def _relu_sql(name: str, before: str) -> str:
    return f"{name} AS (SELECT id, i, greatest(v, 0) AS v FROM {before})"


@query("vectors", _IN + f", {_GCN}, {_layer_sql('a', 'z', 1)}, {_relu_sql('b', 'a')}, {_layer_sql('c', 'b', 2)}, {_relu_sql('f', 'c')}, {_layer_sql('g', 'f', 3)} SELECT id, j AS place, round(h + {_BIAS}, 4) AS value FROM ({_product('g', 4, 4)})")
def q_gcn_stack(spark, sf_dir):
    """Three layers, each normalised over the graph, then a classifier."""
    bound = [lambda v, e, w=w: messages.gcn(v, e, w, [0.0] * OUT) for w in (weight(WIDTH, OUT, 1), weight(OUT, OUT, 2), weight(OUT, OUT, 3))]
    out = messages.stack(*_graph(spark, sf_dir), bound, (weight(OUT, 4, 4), bias(4)))
    return _flat(out, 4)


def _sage_sql(name: str, before: str, step: int) -> str:
    """CTEs of a mean layer with weights of ``step`` and the next, normalised over the graph: (id, i, v) as ``name``."""
    return f"""{name}m AS (SELECT e.dst AS id, i, avg(v) AS v FROM e JOIN {before} z ON z.id = e.src GROUP BY 1, 2), {name}a AS ({_product(before, step)}), {name}b AS ({_product(f'{name}m', step + 1)}),
    {name}r AS (SELECT a.id, a.j AS i, a.h + coalesce(b.h, 0) AS v FROM {name}a a LEFT JOIN {name}b b ON a.id = b.id AND a.j = b.j), {_normed_sql(name)}"""


def _normed_sql(name: str) -> str:
    return f"{name} AS (SELECT id, i, (v - (SELECT avg(v) FROM {name}r)) / ((SELECT stddev_pop(v) FROM {name}r) + 1e-5::DOUBLE) AS v FROM {name}r)"


def _sage(inputs: int, step: int):
    return lambda v, e: messages.sage(v, e, weight(inputs, OUT, step), weight(inputs, OUT, step + 1), [0.0] * OUT)


@query("vectors", _IN + f", {_sage_sql('a', 'z', 1)}, {_relu_sql('b', 'a')}, {_sage_sql('c', 'b', 3)}, {_relu_sql('f', 'c')}, {_sage_sql('g', 'f', 5)} SELECT id, j AS place, round(h + {_BIAS}, 4) AS value FROM ({_product('g', 7, 4)})")
def q_sage_stack(spark, sf_dir):
    """Three mean layers, each normalised over the graph, then a classifier."""
    return _flat(messages.stack(*_graph(spark, sf_dir), [_sage(WIDTH, 1), _sage(OUT, 3), _sage(OUT, 5)], (weight(OUT, 4, 7), bias(4))), 4)


_MANY = 4  # heads of the stack


def _gat_sql(name: str, before: str, step: int, last: bool = False) -> str:
    """CTEs of an attention layer of four heads, side by side or as their mean, normalised over the graph: (id, i, v) as ``name``."""
    flat = f"SELECT id, j AS i, avg(v) AS v FROM {name}o GROUP BY id, j" if last else f"SELECT id, k * {OUT} + j AS i, v FROM {name}o"
    return f"""{name}h AS (SELECT id, k, j, sum(v * {weight_sql('i', 'j', f'({step} + k)')}) AS h FROM {before}, range({OUT}) r(j), range({_MANY}) q(k) GROUP BY id, k, j),
    {name}c AS (SELECT id, k, sum(h * {weight_sql('k', 'j', step + 4)}) AS s, sum(h * {weight_sql('k', 'j', step + 5)}) AS t FROM {name}h GROUP BY id, k),
    {name}w AS (SELECT l.src, l.dst, a.k, CASE WHEN a.s + b.t > 0 THEN a.s + b.t ELSE 0.2::DOUBLE * (a.s + b.t) END AS e FROM l JOIN {name}c a ON a.id = l.src JOIN {name}c b ON b.id = l.dst AND b.k = a.k),
    {name}u AS (SELECT src, dst, k, exp(e - max(e) OVER (PARTITION BY dst, k)) AS w FROM {name}w),
    {name}o AS (SELECT u.dst AS id, u.k AS k, h.j AS j, sum(u.w * h.h) / sum(u.w) AS v FROM {name}u u JOIN {name}h h ON h.id = u.src AND h.k = u.k GROUP BY u.dst, u.k, h.j),
    {name}r AS ({flat}), {_normed_sql(name)}"""


def _gat(inputs: int, step: int, last: bool = False):
    heads = [weight(inputs, OUT, step + k) for k in range(_MANY)]
    return lambda v, e: messages.gat(v, e, heads, weight(_MANY, OUT, step + 4), weight(_MANY, OUT, step + 5), [0.0] * (OUT if last else _MANY * OUT), concat=not last)


@query("vectors", _IN + f", {_gat_sql('a', 'z', 1)}, {_relu_sql('b', 'a')}, {_gat_sql('c', 'b', 2)}, {_relu_sql('f', 'c')}, {_gat_sql('g', 'f', 3, True)} SELECT id, j AS place, round(h + {_BIAS}, 4) AS value FROM ({_product('g', 7, 4)})")
def q_gat_stack(spark, sf_dir):
    """Three attention layers of four heads, the last one's averaged, each normalised over the graph, then a classifier."""
    return _flat(messages.stack(*_graph(spark, sf_dir), [_gat(WIDTH, 1), _gat(_MANY * OUT, 2), _gat(_MANY * OUT, 3, True)], (weight(OUT, 4, 7), bias(4))), 4)


def _row_normed(rows: str) -> str:
    """(id, i, v) normalised by id, then rectified."""
    return f"SELECT id, i, greatest((v - avg(v) OVER (PARTITION BY id)) / sqrt(var_pop(v) OVER (PARTITION BY id) + 1e-5::DOUBLE), 0) AS v FROM ({rows})"


@query("vectors", _IN + f""", p AS ({_row_normed(f"SELECT id, j AS i, h + {_BIAS} AS v FROM ({_product('z', 1)})")}), {_sage_sql('a', 'p', 2)}, {_relu_sql('b', 'a')}, {_sage_sql('c', 'b', 4)},
    f AS (SELECT c.id, c.i, greatest(c.v, 0) + b.v AS v FROM c JOIN b ON b.id = c.id AND b.i = c.i),
    g AS (SELECT id, i, v FROM p UNION ALL SELECT id, i + {OUT}, v FROM f UNION ALL SELECT id, i + {2 * OUT}, v FROM z), k AS ({_row_normed(f"SELECT id, j AS i, h + {_BIAS} AS v FROM ({_product('g', 1)})")}) SELECT id, j AS place, round(h + {_BIAS}, 4) AS value FROM ({_product('k', 2, 4)})""")
def q_balanced(spark, sf_dir):
    """Projection, two mean layers with a residual, and a classifier over projection, last state and input."""
    out = messages.balanced(*_graph(spark, sf_dir), (weight(WIDTH, OUT, 1), bias(OUT)), [_sage(OUT, 2), _sage(OUT, 4)], _dense(2 * OUT + WIDTH))
    return _flat(out, 4)


# ---- training and evaluation


@query()
def q_mlp(spark, sf_dir):
    """Ten folds of the dense model at its defaults."""
    rows = T.vectors(spark, sf_dir).select("id", F.col("vector").alias("x"), (F.col("label") % 4).alias("y"))
    return training.summary(training.cross_validate(sampling.stratified_folds(rows, 10, "id", "y"), WIDTH, 4))


def _folded(spark, sf_dir, folds=10):
    rows = T.vectors(spark, sf_dir).select("id", F.col("vector").cast("array<double>").alias("x"), (F.col("label") % 4).alias("y"))
    return sampling.stratified_folds(rows, folds, "id", "y")


@query()
def q_minibatch(spark, sf_dir):
    """Ten folds of the dense model by mini-batches."""
    return training.summary(minibatch.cross_validate(_folded(spark, sf_dir), minibatch.Settings(epochs=3)))


@query()
def q_graph_losses(spark, sf_dir):
    """(epoch, fold, loss) of a graph network of three layers."""
    run = graph_training.Training(_folded(spark, sf_dir), _graph(spark, sf_dir)[1], graph_training.Settings("GCN", hidden=64, epochs=3), 10)
    rows = [(e, f, float(loss)) for e, losses in enumerate(run.fit()[1]) for f, loss in enumerate(losses)]
    return spark.createDataFrame(rows, "epoch int, fold int, loss double")


@query()
def q_graph_experiment(spark, sf_dir):
    """Accuracy and F1 over ten folds of every kind of network, after two steps each."""
    few = {"hidden": 32, "layers": 2, "epochs": 2}
    kinds = [graph_training.Settings(k, **few) for k in ("MLP", "GCN", "SAGE")] + [graph_training.Settings("GAT", hidden=8, heads=2, layers=2, epochs=2), graph_training.refiner(**few)]
    return training.experiment(_folded(spark, sf_dir), _graph(spark, sf_dir)[1], kinds)


@query()
def q_ablations(spark, sf_dir):
    """The dense network on each choice of feature blocks: embedding, perspectives, topic, depth, confidence."""
    rows = _folded(spark, sf_dir)
    more = F.array(*[(F.col("id") % (k + 2)).cast("double") for k in range(6)], *[(F.col("id") % 3 == k).cast("double") for k in range(3)], (F.col("id") % 10) / 10.0, (F.col("id") % 7) / 7.0)
    return training.ablations(rows.withColumn("x", F.concat("x", more)), _graph(spark, sf_dir)[1], WIDTH, graph_training.Settings("MLP", epochs=5))


def _weights_of(p):
    """A network's weights by the rule that SQL can follow, for one model."""
    return {k: np.array(weight(v.shape[1], v.shape[2], _step_of(k)))[None] for k, v in p.items()}


_H = 8  # hidden units of the network whose gradients SQL follows


def _step_of(name: str) -> int:
    return len(name) + ord(name[0]) + (int(name[1:]) if name[1:].isdigit() else 0)


def _back_sql(layer: int) -> str:
    """CTEs from d{layer} (id, i, v), the gradient by a layer's rectified outputs, to b{layer}, that by its outputs before normalisation."""
    g, e = weight_sql("0", "i", _step_of(f"g{layer}")), weight_sql("0", "i", _step_of(f"e{layer}"))
    kept = "TRUE" if layer == 1 else f"{g} * (z.v - s.m) / (s.q + 1e-5::DOUBLE) + {e} > 0"
    return f"""r{layer} AS (SELECT d.id, i, z.v - s.m AS c, s.q AS q, s.n AS n, CASE WHEN {kept} THEN d.v * {g} ELSE 0 END AS v FROM d{layer} d JOIN z{layer} z USING (id, i), s{layer} s),
    t{layer} AS (SELECT sum(v) AS s1, sum(v * c) AS s2 FROM r{layer}),
    b{layer} AS (SELECT id, i, (v - s1 / n) / (q + 1e-5::DOUBLE) - c * s2 / (n * q * (q + 1e-5::DOUBLE) * (q + 1e-5::DOUBLE)) AS v FROM r{layer}, t{layer})"""


def _ahead_sql(layer: int, before: str) -> str:
    """CTEs of a layer over (id, i, v): messages x, outputs z, statistics s, results h."""
    g, e = weight_sql("0", "i", _step_of(f"g{layer}")), weight_sql("0", "i", _step_of(f"e{layer}"))
    u = f"{g} * (v - m) / (q + 1e-5::DOUBLE) + {e}"
    return f"""x{layer} AS (SELECT l.dst AS id, i, sum(a.v / sqrt(f.d * t.d)) AS v FROM l JOIN {before} a ON a.id = l.src JOIN d f ON f.id = l.src JOIN d t ON t.id = l.dst GROUP BY 1, 2),
    z{layer} AS (SELECT id, j AS i, h + {weight_sql('0', 'j', _step_of(f'c{layer}'))} AS v FROM ({_product(f'x{layer}', _step_of(f'w{layer}'), _H)})),
    s{layer} AS (SELECT avg(v) AS m, stddev_pop(v) AS q, count(*) AS n FROM z{layer}),
    h{layer} AS (SELECT id, i, {u if layer == 1 else f'greatest({u}, 0)'} AS v FROM z{layer}, s{layer})"""


_STEP = f"""{_GCN}, {_ahead_sql(0, 'z')}, {_ahead_sql(1, 'h0')},
    o AS (SELECT id, j, h + {weight_sql('0', 'j', _step_of('kb'))} AS v FROM ({_product('h1', _step_of('k'), 4)})),
    p AS (SELECT id, j, exp(v - max(v) OVER (PARTITION BY id)) AS e FROM o), y AS (SELECT id, label % 4 AS y FROM vectors WHERE id % 2 = 1),
    dl AS (SELECT id, j, (e / s - CASE WHEN j = y THEN 1 ELSE 0 END) / (SELECT count(*) FROM y)::DOUBLE AS v FROM (SELECT id, j, e, sum(e) OVER (PARTITION BY id) AS s FROM p) JOIN y USING (id)),
    d1 AS (SELECT id, i, coalesce(sum(dl.v * {weight_sql('i', 'j', _step_of('k'))}), 0) AS v FROM h1 LEFT JOIN dl USING (id) GROUP BY id, i), {_back_sql(1)},
    n1 AS (SELECT id, j AS i, sum(b.v * {weight_sql('j', 'b.i', _step_of('w1'))}) AS v FROM b1 b, range({_H}) r(j) GROUP BY id, j),
    d0 AS (SELECT l.src AS id, i, sum(a.v / sqrt(f.d * t.d)) AS v FROM l JOIN n1 a ON a.id = l.dst JOIN d f ON f.id = l.src JOIN d t ON t.id = l.dst GROUP BY 1, 2), {_back_sql(0)}"""


@query("vectors", _IN + f""", {_STEP}
    SELECT 'k' AS name, i, j, round(sum(h1.v * dl.v), 6) + 0.0::DOUBLE AS value FROM h1 JOIN dl USING (id) GROUP BY i, j
    UNION ALL SELECT 'w1', x1.i, b1.i, round(sum(x1.v * b1.v), 6) + 0.0::DOUBLE FROM x1 JOIN b1 USING (id) GROUP BY x1.i, b1.i
    UNION ALL SELECT 'w0', x0.i, b0.i, round(sum(x0.v * b0.v), 6) + 0.0::DOUBLE FROM x0 JOIN b0 USING (id) GROUP BY x0.i, b0.i""")
def q_graph_gradients(spark, sf_dir):
    """Gradients of the weights of two graph layers and a classifier, trained on the vertices of odd id."""
    rows = _graph(spark, sf_dir)
    vertices = T.vectors(spark, sf_dir).select("id", (F.col("id") % 2).alias("fold"), F.col("vector").alias("x"), (F.col("label") % 4).alias("y"))
    run = graph_training.Training(vertices, rows[1], graph_training.Settings("GCN", hidden=_H, layers=2, dropout=0.0), 1)
    got = run.gradients(_weights_of(graph_training.initial(run.settings, WIDTH, 1)), 0)[1]
    out = [(name, i, j, round(float(v), 6) + 0.0) for name in ("k", "w1", "w0") for (i, j), v in _cells(got[name][0])]
    return spark.createDataFrame(out, "name string, i long, j long, value double")


def _cells(m):
    return [((i, j), m[i, j]) for i in range(m.shape[0]) for j in range(m.shape[1])]


@query("predictions", """, b AS (SELECT y_true IN (0, 1) AS t, y_pred IN (0, 1) AS p FROM predictions), c AS (SELECT l AS label, count(*) FILTER (WHERE t = l AND p = l) AS tp, count(*) FILTER (WHERE p = l) AS predicted, count(*) FILTER (WHERE t = l) AS support FROM b, (VALUES (TRUE), (FALSE)) v(l) GROUP BY l)
    SELECT label, round(tp / predicted::DOUBLE, 6) AS precision, round(tp / support::DOUBLE, 6) AS recall, round(2.0 * tp::DOUBLE / (predicted + support), 6) AS f1, support FROM c""")
def q_binary_report(spark, sf_dir):
    """Argument or not: reason and statement (0 and 1) against the rest."""
    rows = T.predictions(spark, sf_dir).select(*[relational.binary_collapse(F.col(c), (0, 1)).alias(c) for c in ("y_true", "y_pred")])
    return metrics.per_class(rows).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")

