"""More queries of the topic-sentiment operators: options, edges and importers, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearc.functions.shared import saved
from tonearc.functions.special import lgamma
from tonearc.model import TopicModel
from tonearc.operators import chains, coherence, corpus, gibbs, lexicon, posterior, sentiment, series, summary, synth
from tonearc.plans import fixtures as X
from tonearc.plans import sql as Q
from tonearc.sources import importers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        SQL[name] = oracle


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- texts -----------------------------------------------------------------------------------------------------------

_add(
    "keep_features_unpadded",
    lambda s, d: corpus.keep_features(X.tokens(s, d), X.tokens(s, d).where("word like 'a%'").select(F.translate("word", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("word")).distinct(), ignore=["The", "und"], case_insensitive=True, padding=False),
    f"WITH {Q.TOKENS} SELECT doc_id, pos, word FROM tok WHERE word LIKE 'a%' OR word IN ('the', 'und')",
)
_add(
    "trim_recipe",
    lambda s, d: corpus.trim(X.tokens(s, d), min_docs=10, max_share=0.5, min_letters=3, min_tokens=10, stop_words=["that", "with"], always=["de", "que"]),
    f"""WITH {Q.TOKENS}, long AS (SELECT * FROM tok WHERE doc_id IN (SELECT doc_id FROM tok GROUP BY doc_id HAVING count(*) > 10)),
n AS (SELECT count(DISTINCT doc_id) AS d FROM long),
k AS (SELECT word FROM long GROUP BY word HAVING count(DISTINCT doc_id) >= 10 AND count(DISTINCT doc_id) < (SELECT d FROM n) * 0.5 AND length(word) >= 3 AND word NOT IN ('that', 'with') UNION SELECT unnest(['de', 'que']))
SELECT doc_id, pos, CASE WHEN k.word IS NULL THEN NULL ELSE long.word END AS word FROM long LEFT JOIN k ON k.word = long.word""",
)
_add(
    "virtual_documents_boolean",
    lambda s, d: corpus.virtual_documents(X.tokens(s, d), None).select("doc_id", "start", F.size("words").alias("n"), F.md5(F.array_join("words", " ").cast("binary")).alias("digest")),
    f"WITH {Q.TOKENS} SELECT doc_id, 0::INT AS start, count(*)::INT AS n, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM tok GROUP BY doc_id",
)
_BOOL = f"""{Q.model()}{Q.phi()}, topw AS (SELECT z, word FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY p DESC, word) AS r FROM phi) WHERE r <= 10),
nw AS (SELECT count(DISTINCT doc_id) AS w FROM tok), tw AS (SELECT DISTINCT doc_id, word FROM tok WHERE word IN (SELECT word FROM topw)), sg AS (SELECT word, count(*) AS c FROM tw GROUP BY word),
bo AS (SELECT a.word AS w1, b.word AS w2, count(*) AS c FROM tw a JOIN tw b USING (doc_id) GROUP BY ALL)
SELECT w1, w2, round(x.c / w, 8) AS p1, round(y.c / w, 8) AS p2, round(bo.c / w, 8) AS p12, round(CASE WHEN bo.c = w THEN 1 ELSE ln((bo.c / w) / ((x.c / w) * (y.c / w))) / -ln(bo.c / w) END, 8) AS npmi
FROM bo JOIN sg x ON x.word = w1 JOIN sg y ON y.word = w2 CROSS JOIN nw"""
_add("cooccurrence_boolean", lambda s, d: rounded(coherence.npmi(coherence.cooccurrence((m := X.lda(s, d)).tokens, "boolean", summary.top_word_index(m).select("word").distinct())), 8), _BOOL)

_add(
    "html_main_block",
    lambda s, d: importers.html_paragraphs(s.read.parquet(f"{d}/pages.parquet"), main=r"(?is)<article>(.*?)</article>", stop="</article>").select("page_id", "kind", "text"),
    r"""WITH m AS (SELECT page_id, CASE WHEN regexp_matches(coalesce(html, ''), '(?is)<article>(.*?)</article>') THEN regexp_extract(html, '(?is)<article>(.*?)</article>', 1) ELSE coalesce(html, '') END AS html FROM pages),
b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:h1|h2|p)(?:\s[^>]*)?>.*?</(?:h1|h2|p)>')) AS block FROM m),
t AS (SELECT page_id, lower(regexp_extract(block, '^<(\w+)', 1)) AS kind,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, kind, text FROM t WHERE length(text) > 0""",
)

# ---- importers -------------------------------------------------------------------------------------------------------


def _assigned(s: SparkSession, d: str) -> TopicModel:
    """An import of the fixture's assignments under the defaults of collapsed samplers."""
    return importers.from_lda_package(X.lda(s, d).tokens, 5, docs=X.docs(s, d))


_ZD = f"{Q.model()}, x AS (SELECT doc_id, l1, n1 AS n, sum(n1) OVER (PARTITION BY doc_id) AS tot FROM mix)"
_add("import_assignments", lambda s, d: rounded(posterior.doc_l1(_assigned(s, d)), 8), f"{_ZD} SELECT doc_id, l1, n::BIGINT AS n, round((n + 10e0) / (tot + 50e0), 8) AS p FROM x")
_add("import_assignments_phi", lambda s, d: rounded(posterior.phi(_assigned(s, d)).drop("l1", "l2"), 10), f"{Q.model()}{Q.phi()} SELECT word, z, n, round(p, 10) AS p FROM phi")


def _mixtures(s: SparkSession, d: str) -> TopicModel:
    m = X.lda(s, d)
    theta, phi = posterior.doc_l1(m).select("doc_id", F.col("l1").alias("z"), "p"), posterior.phi(m).select("word", "z", "p")
    return importers.from_mixtures(theta, corpus.bag_of_words(m.tokens), phi, 5)


_add("import_mixtures_bag", lambda s, d: corpus.bag_of_words(_mixtures(s, d).tokens), f"WITH {Q.TOKENS} SELECT doc_id, word, count(*) AS n FROM tok GROUP BY ALL")
_add("ldavis_doc_length", lambda s, d: summary.ldavis_tables(X.lda(s, d))["doc_length"], f"WITH {Q.TOKENS} SELECT docs.doc_id, count(tok.doc_id) AS doc_length FROM docs LEFT JOIN tok ON tok.doc_id = docs.doc_id GROUP BY docs.doc_id")

# ---- models ----------------------------------------------------------------------------------------------------------

_add(
    "start_allowed",  # where tokens start is drawn; that each starts where its word may be is not
    lambda s, d: (m := gibbs.start(X.rjst(s, d))).tokens.join(m.vocab, "word").groupBy("doc_id").agg(F.count_if((F.col("z") >= 0) & (F.col("z") < m.Z) & m.allowed()).alias("allowed"), F.count("z").alias("n")),
    f"WITH {Q.TOKENS} SELECT doc_id, count(*) AS allowed, count(*) AS n FROM tok GROUP BY doc_id",
)


def _grown(s: SparkSession, d: str) -> TopicModel:
    m = X.lda(s, d)
    return gibbs.from_lda(m, lexicon.match(m.vocab.select("word"), X.LEXICON, ["negative", "positive"]), S=3)


_add("rjst_from_lda_topics", lambda s, d: rounded(posterior.doc_l1(_grown(s, d)), 8), f"{Q.model()} SELECT doc_id, l1, n1::BIGINT AS n, round(l1_p, 8) AS p FROM mix")
_add(
    "rjst_from_lda_lexicon",
    lambda s, d: (m := _grown(s, d)).tokens.join(m.vocab.where("lex is not null"), "word").groupBy("lex", (F.col("z") % 3).alias("sentiment")).agg(F.count(F.lit(1)).alias("n")),
    f"WITH {Q.TOKENS}, {Q.LEX} SELECT lex, CASE lex WHEN 'negative' THEN 0 ELSE 2 END::INT AS sentiment, count(*) AS n FROM tok JOIN lexv USING (word) WHERE lex IS NOT NULL GROUP BY lex",
)


def _recompiled(s: SparkSession, d: str) -> TopicModel:
    return gibbs.recompile(X.rjst(s, d), {"negative": ["a*"], "positive": ["*s"]})


_add(
    "recompiled_vocabulary",
    lambda s, d: (m := _recompiled(s, d)).tokens.join(m.vocab, "word").groupBy("word", "lex").agg(F.count_if(m.allowed()).alias("n")),
    f"WITH {Q.TOKENS} SELECT word, CASE WHEN word LIKE 'a%' AND word LIKE '%s' THEN NULL WHEN word LIKE 'a%' THEN 'negative' WHEN word LIKE '%s' THEN 'positive' END AS lex, count(*) AS n FROM tok GROUP BY word",
)


def _broken(s: SparkSession, d: str) -> TopicModel:
    """The rJST with tokens out of range, in leaves that the lexicon forbids, and of words that the vocabulary lacks."""
    m = X.rjst(s, d)
    z = F.when(F.col("doc_id") % 11 == 0, F.col("z") + 15).when(F.col("doc_id") % 7 == 0, (F.col("z") + 1) % 15).otherwise(F.col("z"))
    return replace(m, tokens=m.tokens.withColumn("z", z.cast("int")), vocab=m.vocab.where("word not like 'q%'"))


_add("integrity_broken", lambda s, d: posterior.integrity(_broken(s, d)).select("za", "toks", "lex"), f"WITH {Q.TOKENS} SELECT count(*) FILTER (WHERE doc_id % 11 = 0) = 0 AS za, count(*) FILTER (WHERE word LIKE 'q%') = 0 AS toks, false AS lex FROM tok")
_add(
    "integrity_detailed",
    lambda s, d: posterior.integrity(_broken(s, d), detailed=True).select("za", "toks", "lex"),
    f"""{Q.model('rjst')} SELECT count(*) FILTER (WHERE doc_id % 11 = 0) AS za, count(*) FILTER (WHERE word LIKE 'q%') AS toks,
count(*) FILTER (WHERE doc_id % 11 <> 0 AND word NOT LIKE 'q%' AND lex IS NOT NULL AND (CASE lex WHEN 'negative' THEN 0 ELSE 2 END) <> (CASE WHEN doc_id % 7 = 0 THEN (z + 1) % 15 ELSE z END) % 3) AS lex FROM asg JOIN lexv USING (word)""",
)
for _k, _m in (("lda", X.lda), ("rjst", X.rjst), ("jst", X.jst)):
    _add(f"integrity_counts_{_k}", lambda s, d, m=_m: posterior.integrity(m(s, d), detailed=True), "SELECT 0::BIGINT AS za, 0::BIGINT AS toks, 0::BIGINT AS lex, 0::BIGINT AS l1, 0::BIGINT AS l2, 0::BIGINT AS phi")

_add(
    "inverted_l2",
    lambda s, d: rounded(posterior.l2_counts(posterior.doc_l2(m := X.rjst(s, d)), posterior.doc_l1(m).select("doc_id", "l1", "n"), m.l2_prior, m.L1)).withColumn("n", F.round("n", 4) + 0.0),
    f"{Q.model('rjst')} SELECT doc_id, l1, l2, n::DOUBLE AS n FROM mix",
)
_add(
    "inverted_phi",
    lambda s, d: posterior.word_counts_from_phi(posterior.phi_cells(m := X.rjst(s, d)).select("word", "z", "p", "beta"), m.tokens.where("word is not null").groupBy("z").agg(F.count(F.lit(1)).alias("n_z"))).select("word", "z", (F.round("n", 4) + 0.0).alias("n")),
    f"{Q.model('rjst')}{Q.phi('rjst')} SELECT word, z, n::DOUBLE AS n FROM cell",
)
_add(
    "repaired_counts",
    lambda s, d: importers.counts_as_model(posterior.doc_l1(m := X.lda(s, d)).select("doc_id", "l1", "p"), posterior.count_zd(m).groupBy("doc_id").agg(F.sum("n").alias("length")), m.l1_prior),
    f"{Q.model()} SELECT doc_id, l1, n1::BIGINT AS n FROM mix WHERE doc_id IN (SELECT doc_id FROM zd)",
)


def _margins(s: SparkSession, d: str) -> DataFrame:
    """Counts of leaves blurred towards each other, with both margins of the fixture."""
    m = X.lda(s, d)
    exact = saved(posterior.doc_l1(m).join(posterior.count_zd(m).groupBy("doc_id").agg(F.sum("n").alias("total")), "doc_id"), "exact")  # read four times
    blurred = exact.select("doc_id", "l1", (F.col("n") * 0.7 + F.col("total") * 0.06).alias("n"))
    wanted = {r.l1: r.n for r in exact.groupBy("l1").agg(F.sum("n").alias("n")).collect()}
    return posterior.repair_margins(blurred, "doc_id", "l1", exact.select("doc_id", "total").distinct(), wanted)


_add("repaired_margin_documents", lambda s, d: _margins(s, d).groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("n").cast("boolean").isNotNull().alias("whole")), f"{Q.model()} SELECT doc_id, sum(n)::BIGINT AS n, true AS whole FROM zd GROUP BY doc_id")
_add("repaired_margin_topics", lambda s, d: _margins(s, d).groupBy("l1").agg(F.sum("n").alias("n")), f"{Q.model()} SELECT l1, sum(n1)::BIGINT AS n FROM mix GROUP BY l1")

# ---- likelihood ------------------------------------------------------------------------------------------------------

_add("special_lgamma", lambda s, d: X.documents(s, d).select("doc_id", F.round(lgamma(F.col("n_chars") / 7.0 + F.lit(0.1)), 5).alias("x")), "SELECT doc_id, round(lgamma(n_chars / 7.0e0 + 0.1e0), 5) AS x FROM documents")
_add(
    "loglik_w_rjst",
    lambda s, d: posterior.loglik_words(X.rjst(s, d)).select("z", F.round("value", 2).alias("w")),
    f"{Q.model('rjst')}{Q.phi('rjst')} SELECT z, round(sum(lgamma(n + beta + 1e-9) - lgamma(beta + 1e-9)) + lgamma(sum(beta)) - lgamma(sum(n) + sum(beta)), 2) AS w FROM cell GROUP BY z",
)
_add(
    "loglik_l1_documents",
    lambda s, d: rounded(posterior.loglik_l1(replace(X.lda(s, d), alpha=(0.5, 1.0, 1.5, 2.0, 2.5))), 5),
    f"{Q.model()} SELECT doc_id, round(sum(lgamma(n1 + (l1 + 1) / 2.0e0) - lgamma((l1 + 1) / 2.0e0)) + lgamma(7.5e0) - lgamma(sum(n1) + 7.5e0), 5) AS value FROM mix GROUP BY doc_id",
)
_add(
    "loglik_multinomial",
    lambda s, d: rounded(posterior.loglik_l1(X.lda(s, d), multinomial=True), 5),
    f"{Q.model()} SELECT doc_id, round(sum(lgamma(n1 + 1e0) - lgamma(n1 + 1e0)) + lgamma(5e0) - lgamma(sum(n1) + 5e0) + lgamma(sum(n1) + 1e0), 5) AS value FROM mix GROUP BY doc_id",
)
_add(
    "loglik_l2_jst",
    lambda s, d: rounded(posterior.loglik_l2(X.jst(s, d)).groupBy("l1").agg(F.sum("value").alias("value")), 3),
    f"{Q.model('jst')}, p AS (SELECT l1, doc_id, sum(lgamma(n + 5e0) - lgamma(5e0)) - lgamma(sum(n) + 25e0) + lgamma(25e0) AS v FROM mix GROUP BY ALL) SELECT l1, round(sum(v), 3) AS value FROM p GROUP BY l1",
)

# ---- chains ----------------------------------------------------------------------------------------------------------


def _pair(kind: str) -> tuple[Query, str]:
    """Two chains of a two-layer fixture: the second moves every topic to the next."""

    def query(s: SparkSession, d: str, aggregate: str = "sum") -> DataFrame:
        m = X.two_layer(s, d, kind)
        moved = F.col("z").cast("int")
        other = replace(m, tokens=m.tokens.withColumn("z", F.when(F.col("pos") % 3 == 0, (m.topic("z") + 1) % 5 * (m.L2 if kind == "rjst" else 1) + m.sentiment("z") * (1 if kind == "rjst" else m.L2)).otherwise(moved).cast("int")))
        a, b = (posterior.phi(x).select("word", "z", "p") for x in (m, other))
        return s.createDataFrame([(round(chains.distance(m, a, b, "invariantEuclidean", aggregate), 8),)], "distance double")

    t, x = ("z // 3", "z % 3") if kind == "rjst" else ("z % 5", "z // 5")
    z2 = f"((({t}) + 1) % 5) * 3 + {x}" if kind == "rjst" else f"({x}) * 5 + ((({t}) + 1) % 5)"
    first = Q.model(kind) + Q.phi(kind)
    second = Q.model(kind).replace("lf AS (SELECT z,", f"asg2 AS (SELECT doc_id, pos, word, (CASE WHEN pos % 3 = 0 THEN {z2} ELSE z END)::INT AS z FROM asg), lf AS (SELECT z,").replace("zd AS (SELECT doc_id, z, count(*) AS n FROM asg", "zd AS (SELECT doc_id, z, count(*) AS n FROM asg2") + Q.phi(kind).replace("FROM asg GROUP BY ALL", "FROM asg2 GROUP BY ALL")
    return query, f"WITH pa AS ({first} SELECT word, z, p FROM phi), pb AS ({second} SELECT word, z, p FROM phi), d AS (SELECT pa.z AS i, pb.z AS j, sqrt(sum((pa.p - pb.p) * (pa.p - pb.p))) AS d FROM pa JOIN pb ON pa.word = pb.word GROUP BY ALL)"


_perm = " CROSS JOIN ".join(f"c c{i}" for i in range(5))
_where = " AND ".join([f"c{i}.i = {i}" for i in range(5)] + [f"c{i}.j <> c{j}.j" for i in range(5) for j in range(i)])
_total = " + ".join(f"c{i}.d" for i in range(5))
_most = f"greatest({', '.join(f'c{i}.d' for i in range(5))})"
_query, _with = _pair("rjst")
_blocks = ", c AS (SELECT i // 3 AS i, j // 3 AS j, sum(d) AS d FROM d WHERE i % 3 = j % 3 GROUP BY ALL)"
_add("chain_invariant_rjst", _query, f"{_with}{_blocks} SELECT round(min({_total}), 8) AS distance FROM {_perm} WHERE {_where}")
_add("chain_invariant_rjst_max", lambda s, d, q=_query: q(s, d, "max"), f"{_with}{_blocks} SELECT round(arg_min({_most}, {_total}), 8) AS distance FROM {_perm} WHERE {_where}")
_query, _with = _pair("jst")
_parts = ", b AS (SELECT i // 5 AS s, i % 5 AS i, j % 5 AS j, d FROM d WHERE i // 5 = j // 5)"
_each = " UNION ALL ".join(f"SELECT min({_total}) AS m FROM " + " CROSS JOIN ".join(f"(SELECT * FROM b WHERE s = {s}) c{i}" for i in range(5)) + f" WHERE {_where}" for s in range(3))
_add("chain_invariant_jst", _query, f"{_with}{_parts}, e AS ({_each}) SELECT round(max(m), 8) AS distance FROM e")

# ---- metadata and sentiment ------------------------------------------------------------------------------------------

_add(
    "melt_relabelled",
    lambda s, d: rounded(summary.melt(X.rjst(s, d).labels(topic=list("vwxyz"))).select("doc_id", "sentopic", "prob"), 10),
    f"{Q.model('rjst')} SELECT doc_id, (['v', 'w', 'x', 'y', 'z'])[l1 + 1] || '_' || {Q.sentiment('l2')} AS sentopic, round(p, 10) AS prob FROM mix",
)
_RTS = f"{Q.model('rjst')}, ts AS (SELECT doc_id, l1, max(p) FILTER (WHERE l2 = 2) - max(p) FILTER (WHERE l2 = 0) AS s, max(l2_p) FILTER (WHERE l2 = 2) - max(l2_p) FILTER (WHERE l2 = 0) AS c, max(l1_p) AS theta FROM mix GROUP BY doc_id, l1)"
_add("topic_sentiment_conditional", lambda s, d: rounded(sentiment.topic_sentiment(X.rjst(s, d), conditional=True), 8), f"{_RTS} SELECT doc_id, l1 AS topic, round(c, 8) AS s, round(theta, 8) AS theta FROM ts")
_add("sentiment_override", lambda s, d: rounded(sentiment.document_sentiment(X.rjst_external(s, d), override=True), 8), f"{_RTS} SELECT doc_id, round(sum(s * theta), 8) AS sentiment FROM ts GROUP BY doc_id")
_add("sentiment_stored", lambda s, d: rounded(sentiment.document_sentiment(X.rjst_external(s, d), include_docs=True)), f"WITH {Q.TOKENS} SELECT doc_id, round(sentiment, 6) AS sentiment, date FROM docs")
_add("replaced_dates", lambda s, d: rounded(series.sentiment_series((m := X.lda(s, d)).with_dates(m.docs.select("doc_id", F.add_months("date", 1).alias("date"))), "month", scale=False)), f"WITH {Q.TOKENS} SELECT date_trunc('month', date + INTERVAL 1 month)::DATE AS date, round(avg(sentiment), 6) AS value FROM docs GROUP BY 1")
_add("document_shares", lambda s, d: rounded(summary.sentiment_shares(X.lda(s, d)), 8), f"{Q.model()} SELECT doc_id, {Q.topic()} AS topic, date, round(l1_p * sentiment, 8) AS share FROM mix JOIN docs USING (doc_id)")

# ---- series ----------------------------------------------------------------------------------------------------------

_SER = f"WITH {Q.TOKENS}, ser AS (SELECT date_trunc('month', date)::DATE AS date, avg(sentiment) AS value FROM docs GROUP BY 1)"


def _rolled(fun: str, before: int, after: int) -> str:
    return f"""{_SER}, c AS (SELECT t.d::DATE AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM ser)::TIMESTAMP, (SELECT max(date) FROM ser)::TIMESTAMP, INTERVAL 1 month)) AS d) t),
r AS (SELECT c.date, value AS v, {fun}(value) OVER w AS x, count(*) OVER w AS k FROM c LEFT JOIN ser USING (date) WINDOW w AS (ORDER BY c.date ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING))
SELECT date, round(CASE WHEN k = {before + after + 1} THEN x END, 6) AS value FROM r WHERE v IS NOT NULL"""


for _name, _fun in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("median", "median"), ("sd", "stddev_samp")):
    _add(f"sentiment_series_rolling_{_name}", lambda s, d, f=_name: rounded(series.sentiment_series(X.lda(s, d), "month", 4, scale=False, fun=f)), _rolled(_fun, 3, 0))
_add("sentiment_series_left", lambda s, d: rounded(series.sentiment_series(X.lda(s, d), "month", 3, scale=False, align="left")), _rolled("avg", 0, 2))
_add("sentiment_series_center", lambda s, d: rounded(series.sentiment_series(X.lda(s, d), "month", 3, scale=False, align="center")), _rolled("avg", 1, 1))
_add(
    "sentiment_series_scaling_period",
    lambda s, d: rounded(series.sentiment_series(X.lda(s, d), "month", scaling_period=("2020-06-01", "2021-06-01"))),
    f"{_SER}, par AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM ser WHERE date BETWEEN DATE '2020-06-01' AND DATE '2021-06-01') SELECT date, round((value - m) / sd, 6) AS value FROM ser CROSS JOIN par",
)
_add(
    "scaled_topic_sentiment",
    lambda s, d: rounded(series.scaled_topic_sentiment(X.rjst(s, d), "month"), 5),
    f"""{_RTS}, sen AS (SELECT doc_id, sum(s * theta) AS v FROM ts GROUP BY doc_id), ser AS (SELECT date_trunc('month', date)::DATE AS date, avg(v) AS value FROM sen JOIN docs USING (doc_id) GROUP BY 1),
par AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM ser) SELECT doc_id, l1 AS topic, round((s - m) / sd, 5) AS s FROM ts CROSS JOIN par""",
)
_add(
    "apply_rolling",
    lambda s, d: rounded(series.apply_rolling(series.proportion_topics(X.lda(s, d), "month"), 3, _spread)),
    f"""{Q.model()}, al AS (SELECT date_trunc('month', date)::DATE AS date, {Q.topic()} AS topic, avg(l1_p) AS value FROM mix JOIN docs USING (doc_id) GROUP BY ALL)
SELECT date, topic, round(CASE WHEN count(*) OVER w = 3 THEN max(value) OVER w - min(value) OVER w END, 6) AS value FROM al WINDOW w AS (PARTITION BY topic ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)


def _spread(values) -> float:
    return max(values) - min(values)


def _plot(period: str, table: str) -> str:
    """A plot table of the series `table` (date, topic, value)."""
    step = {"month": "INTERVAL 1 month", "quarter": "INTERVAL 3 month", "year": "INTERVAL 1 year"}[period]
    return f"""cal AS (SELECT t.d::DATE AS date, topic FROM (SELECT unnest(generate_series((SELECT min(date) FROM {table})::TIMESTAMP, (SELECT max(date) FROM {table})::TIMESTAMP, {step})) AS d) t CROSS JOIN (SELECT DISTINCT topic FROM {table})),
fil AS (SELECT cal.date, cal.topic, last_value(value IGNORE NULLS) OVER (PARTITION BY cal.topic ORDER BY cal.date) AS value, date_diff('day', cal.date, (cal.date + {step})::DATE)::INT AS width FROM cal LEFT JOIN {table} al ON al.date = cal.date AND al.topic = cal.topic)
SELECT date, topic, round(value, 6) AS value, width, (date + (width // 2)::INT)::DATE AS centre"""


for _period in ("month", "quarter", "year"):
    _al = f"{Q.model()}, al AS (SELECT date_trunc('{_period}', date)::DATE AS date, {Q.topic()} AS topic, avg(l1_p) AS value FROM mix JOIN docs USING (doc_id) GROUP BY ALL)"
    _add(f"proportion_plot_{_period}", lambda s, d, p=_period: rounded(series.plot_table(series.proportion_topics(X.lda(s, d), p), p)), f"{_al}, {_plot(_period, 'al')} FROM fil")
_TOP = f"{Q.model()}, al AS (SELECT date_trunc('month', date)::DATE AS date, {Q.topic()} AS topic, sum(sentiment * l1_p) / sum(l1_p) AS value FROM mix JOIN docs USING (doc_id) GROUP BY ALL)"
_add("sentiment_topics_plot", lambda s, d: rounded(series.plot_table(series.sentiment_topics(X.lda(s, d), "month"), "month", ridgeline=True)), f"{_TOP}, {_plot('month', 'al')}, round(value / max(abs(value)) OVER (), 6) AS height FROM fil")

# ---- summaries -------------------------------------------------------------------------------------------------------

_TW = f"{Q.model()}{Q.phi()}, b AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY p DESC, word)::INT AS rank FROM phi QUALIFY rank <= 5)"
_add("top_words_plot", lambda s, d: rounded(summary.top_words_plot(X.lda(s, d), 5, "probability"), 8), f"{_TW} SELECT {Q.topic('z')} AS facet, word, rank, round(p, 8) AS value, word || '___' || {Q.topic('z')} AS item, (row_number() OVER (ORDER BY z, p, word DESC))::INT AS place FROM b")
_add(
    "sunburst_layers",
    lambda s, d: rounded(summary.sunburst(X.rjst(s, d), layers=2, sort=True, colors=True)),
    f"""{Q.model('rjst')}, a1 AS (SELECT l1, avg(l1_p) AS v FROM mix WHERE l2 = 0 GROUP BY l1), a2 AS (SELECT l1, l2, avg(p) AS v FROM mix GROUP BY ALL),
u AS (SELECT {Q.topic()} AS id, '' AS parent, {Q.topic()} AS label, 1 AS level, v AS value, v AS real FROM a1
UNION ALL SELECT {Q.topic('a2.l1')} || '/' || {Q.sentiment('l2')}, {Q.topic('a2.l1')}, {Q.sentiment('l2')}, 2, a2.v, a2.v / a1.v FROM a2 JOIN a1 USING (l1)),
o AS (SELECT *, row_number() OVER (ORDER BY level, value DESC, id)::INT AS place FROM u)
SELECT id, parent, label, level, round(value, 6) AS value, round(real, 6) AS real, place, CASE WHEN level = 2 THEN CASE label WHEN 'negative' THEN '#d14747' WHEN 'neutral' THEN '#d1d147' ELSE '#47d147' END ELSE (['#d14747', '#b6d147', '#47d17e', '#477ed1', '#b647d1'])[substr(id, 6)::INT] END AS color FROM o""",
)

# ---- generated -------------------------------------------------------------------------------------------------------

_add(
    "generated_vocabulary",
    lambda s, d: rounded(synth.generate_vocabulary(s, 4, 3, words=5, common=2), 9),
    """WITH g AS (SELECT t, s FROM range(1, 5) a(t) CROSS JOIN range(1, 4) b(s)), i AS (SELECT unnest(range(1, 6)) AS i), c AS (SELECT unnest(range(1, 3)) AS i),
w AS (SELECT 'topic' || t || 'sent' || s || 'w' || i AS word, t, s FROM g, i UNION ALL SELECT 'topic' || t || 'w' || i, t, s FROM g, c UNION ALL SELECT 'sentiment' || s || 'w' || i, t, s FROM g, c)
SELECT word, t::INT AS topic, s::INT AS sent, round(1 / 9.0e0, 9) AS p FROM w""",
)
_add(
    "generated_lexicon",
    lambda s, d: lexicon.match((v := synth.generate_vocabulary(s, 3, 3)).select("word").distinct(), lexicon.partial(v, 2), ["negative", "positive"]),
    """WITH w AS (SELECT 'topic' || t || 'sent' || s || 'w' || i AS word, NULL AS lex FROM range(1, 4) a(t), range(1, 4) b(s), range(1, 6) c(i) UNION ALL SELECT 'topic' || t || 'w' || i, NULL FROM range(1, 4) a(t), range(1, 3) c(i)
UNION ALL SELECT 'sentiment' || s || 'w' || i, CASE WHEN s = 2 THEN 'negative' ELSE 'positive' END FROM range(1, 4) b(s), range(1, 3) c(i)) SELECT word, lex FROM w""",
)
