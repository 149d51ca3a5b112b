"""Queries of the topic-sentiment operators over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import chains, coherence, corpus, gibbs, lexicon, merging, posterior, sentiment, series, summary, synth
from tonearc.plans import fixtures as X
from tonearc.plans import more
from tonearc.plans import sql as Q
from tonearc.sources import importers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle is not None:
        _SQL[name] = oracle


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: engines add in another order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions(spark, sf_dir)


# ---- texts and tokens ------------------------------------------------------------------------------------------------

_add("tokens_bow", lambda s, d: corpus.bag_of_words(X.tokens(s, d)), f"WITH {Q.TOKENS} SELECT doc_id, word, count(*) AS n FROM tok GROUP BY ALL")
_add("vocabulary", lambda s, d: corpus.vocabulary(X.tokens(s, d)), f"WITH {Q.TOKENS} SELECT row_number() OVER (ORDER BY word COLLATE C) - 1 AS word_id, word, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY word".replace(" COLLATE C", ""))
_add(
    "bow_to_tokens_roundtrip",
    lambda s, d: corpus.bag_of_words(corpus.bag_to_tokens(corpus.bag_of_words(X.tokens(s, d)))),
    f"WITH {Q.TOKENS} SELECT doc_id, word, count(*) AS n FROM tok GROUP BY ALL",
)
_add("keep_features_padded", lambda s, d: corpus.trim(X.tokens(s, d), min_docs=X.MIN_DOCS, min_letters=1), f"WITH {Q.TOKENS}, {Q.TRIM} SELECT doc_id, pos, word FROM tt")
_add(
    "collocations",
    lambda s, d: corpus.collocations(X.tokens(s, d), 5),
    f"WITH {Q.TOKENS}, p AS (SELECT word AS first, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tok) SELECT first, second, count(*) AS n FROM p WHERE second IS NOT NULL GROUP BY ALL HAVING count(*) >= 5",
)
_add(
    "html_paragraphs",
    lambda s, d: importers.html_paragraphs(s.read.parquet(f"{d}/pages.parquet")),
    r"""WITH b AS (SELECT page_id, unnest(range(len(a)))::INT AS paragraph, unnest(a) AS block FROM (
  SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<(?:h1|h2|p)(?:\s[^>]*)?>.*?</(?:h1|h2|p)>') AS a FROM pages)),
t AS (SELECT page_id, paragraph, lower(regexp_extract(block, '^<(\w+)', 1)) AS kind,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, paragraph, page_id || '_' || (paragraph + 1) AS paragraph_id, kind, text FROM t WHERE length(text) > 0""",
)

# ---- lexicon ---------------------------------------------------------------------------------------------------------

_add("lexicon_match", lambda s, d: lexicon.match(X.tokens(s, d).select("word").distinct(), X.LEXICON, ["negative", "positive"]), f"WITH {Q.TOKENS}, {Q.LEX} SELECT word, lex FROM lexv")
def _greedy(starts: str, span: int) -> str:
    """Starts (doc_id, pos) of a table that a reader from left to right takes, as a fold over each document's list."""
    return f"(SELECT doc_id, unnest(list_reduce(list([pos] ORDER BY pos), lambda a, x: CASE WHEN x[1] >= a[len(a)] + {span} THEN list_concat(a, x) ELSE a END)) AS pos FROM {starts} GROUP BY doc_id)"


_KINDS = f"""WITH {Q.TOKENS}, {Q.LEX},
k AS (SELECT doc_id, pos, word, lex, word IN ('to', 'no', 'de', 'la') AS neg, word IN ('in', 'die', 'que', 'of') AS amp FROM tok JOIN lexv USING (word)),
s3 AS (SELECT a.doc_id, a.pos, c.word AS w, c.lex AS x FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN k c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.neg AND b.amp AND c.lex IS NOT NULL),
g3 AS {_greedy('s3', 3)},
t3 AS (SELECT doc_id, pos + unnest([0, 1, 2]) AS pos FROM g3),
s2 AS (SELECT a.doc_id, a.pos, b.word AS w, b.lex AS x FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.neg AND b.lex IS NOT NULL
  AND NOT EXISTS (FROM t3 WHERE t3.doc_id = a.doc_id AND t3.pos = a.pos) AND NOT EXISTS (FROM t3 WHERE t3.doc_id = a.doc_id AND t3.pos = a.pos + 1)),
g2 AS {_greedy('s2', 2)},
h AS (SELECT s3.*, 3 AS span FROM s3 JOIN g3 USING (doc_id, pos) UNION ALL SELECT s2.*, 2 FROM s2 JOIN g2 USING (doc_id, pos)),
e AS (SELECT doc_id, pos + 1 AS pos FROM h UNION ALL SELECT doc_id, pos + 2 FROM h WHERE span = 3),
c AS (SELECT k.doc_id, k.pos, CASE WHEN h.span IS NULL THEN k.word ELSE '#NEG#__' || h.w END AS word, CASE WHEN h.span IS NULL THEN k.lex WHEN h.x = 'positive' THEN 'negative' ELSE 'positive' END AS lex, h.span IS NOT NULL AS compounded
  FROM k LEFT JOIN h ON h.doc_id = k.doc_id AND h.pos = k.pos WHERE NOT EXISTS (FROM e WHERE e.doc_id = k.doc_id AND e.pos = k.pos))
"""
_add("lexicon_negation", lambda s, d: lexicon.compound_texts(X.documents(s, d), X.LEXICON, ["negative", "positive"]), _KINDS + "SELECT * FROM c")
_add(
    "lexicon_compounds",
    lambda s, d: lexicon.compound_texts(X.documents(s, d), X.LEXICON, ["negative", "positive"]).where("compounded").groupBy("word", "lex").agg(F.count(F.lit(1)).alias("n")),
    _KINDS + "SELECT word, lex, count(*) AS n FROM c WHERE compounded GROUP BY ALL",
)


def _ngram_lexicon(s: SparkSession, d: str) -> DataFrame:
    pairs = corpus.collocations_of(corpus.token_lists(X.documents(s, d)), 20).select(F.concat_ws(" ", "first", "second").alias("keyword"), F.lit(2).alias("ngram"))
    weight = lambda k: (F.length("keyword") * k % 7 / 7.0).alias
    return pairs.select("keyword", "ngram", weight(1)("mp_acco"), weight(2)("mp_neut"), weight(3)("mp_rest"), weight(4)("ec_nega"), weight(5)("ec_neut"), weight(6)("ec_posi"))


def _segments(s: SparkSession, d: str) -> DataFrame:
    return X.documents(s, d).select("doc_id", "text", "source")


_NGRAM = f"""WITH {Q.TOKENS},
big AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS keyword FROM tok),
lexi AS (SELECT keyword, length(keyword) AS n FROM big WHERE keyword IS NOT NULL GROUP BY keyword HAVING count(*) >= 20),
hit AS (SELECT doc_id, pos, n FROM big JOIN lexi USING (keyword)),
gr AS {_greedy('hit', 2)},
mark AS (SELECT doc_id, pos, n FROM hit JOIN gr USING (doc_id, pos)),
per AS (SELECT doc_id, sum((n * 3 % 7) / 7.0e0 - (n % 7) / 7.0e0) AS mp, sum((n * 6 % 7) / 7.0e0 - (n * 4 % 7) / 7.0e0) AS ec,
  sum((n % 7) / 7.0e0 + (n * 2 % 7) / 7.0e0 + (n * 3 % 7) / 7.0e0) AS mpa, sum((n * 4 % 7) / 7.0e0 + (n * 5 % 7) / 7.0e0 + (n * 6 % 7) / 7.0e0) AS eca FROM mark GROUP BY doc_id),
b AS (SELECT doc_id, source, coalesce(mp, 0) AS mp, coalesce(ec, 0) AS ec, avg(coalesce(mpa, 0)) OVER (PARTITION BY source) AS mpm, avg(coalesce(eca, 0)) OVER (PARTITION BY source) AS ecm FROM documents LEFT JOIN per USING (doc_id))
SELECT doc_id, round(mp / greatest(mpm, sqrt(2.220446049250313e-16)), 6) + 0e0 AS mp, round(ec / greatest(ecm, sqrt(2.220446049250313e-16)), 6) + 0e0 AS ec FROM b"""
_add(
    "ngram_scores",  # + 0 makes -0 of sums that cancel 0
    lambda s, d: rounded(lexicon.ngram_scores(_segments(s, d), _ngram_lexicon(s, d), parent_col="source", stemmed=False)).select("doc_id", *[(F.col(c) + 0.0).alias(c) for c in ("mp", "ec")]),
    _NGRAM,
)
_add(
    "ngram_scores_per_word",
    lambda s, d: rounded(lexicon.ngram_scores(_segments(s, d), _ngram_lexicon(s, d), parent_col="source", stemmed=False, per_word=True)).select("doc_id", "keyword", *[(F.col(c) + 0.0).alias(c) for c in ("mp", "ec")]),
    _NGRAM[: _NGRAM.index("SELECT doc_id, round(mp")] + """, pw AS (SELECT hit.doc_id, keyword, count(*) AS k, any_value(hit.n) AS n FROM hit JOIN mark USING (doc_id, pos) JOIN big USING (doc_id, pos) GROUP BY ALL)
SELECT pw.doc_id, keyword, round(k * ((n * 3 % 7) / 7.0e0 - (n % 7) / 7.0e0) / greatest(mpm, sqrt(2.220446049250313e-16)), 6) + 0e0 AS mp, round(k * ((n * 6 % 7) / 7.0e0 - (n * 4 % 7) / 7.0e0) / greatest(ecm, sqrt(2.220446049250313e-16)), 6) + 0e0 AS ec FROM pw JOIN b USING (doc_id)""",
)


def _stemmed_lexicon(s: SparkSession, d: str) -> DataFrame:
    """The same weights on frequent pairs of stems."""
    lists = lexicon.stemmed_lists(corpus.token_lists(X.documents(s, d)))
    pairs = corpus.collocations_of(lists, 20).select(F.concat_ws(" ", "first", "second").alias("keyword"), F.lit(2).alias("ngram"))
    weight = lambda k: (F.length("keyword") * k % 7 / 7.0).alias
    return pairs.select("keyword", "ngram", weight(1)("mp_acco"), weight(2)("mp_neut"), weight(3)("mp_rest"), weight(4)("ec_nega"), weight(5)("ec_neut"), weight(6)("ec_posi"))


_add("ngram_scores_stemmed", lambda s, d: lexicon.ngram_scores(_segments(s, d), _stemmed_lexicon(s, d), parent_col="source"))

# ---- counts and posteriors -------------------------------------------------------------------------------------------

_MODELS: dict[str, Callable[[SparkSession, str], TopicModel]] = {"lda": X.lda, "rjst": X.rjst, "jst": X.jst}

for _k, _m in _MODELS.items():
    _w = Q.model(_k)
    _p = _w + Q.phi(_k)
    _topic, _sent = ("l2", "l1") if _k == "jst" else ("l1", "l2")
    _add(f"count_zw_{_k}", lambda s, d, m=_m: posterior.count_zw(m(s, d)), f"{_w} SELECT z, word, count(*) AS n FROM asg GROUP BY ALL")
    _add(f"count_zd_{_k}", lambda s, d, m=_m: posterior.count_zd(m(s, d)), f"{_w} SELECT doc_id, z, n FROM zd")
    _add(f"l1_mixture_{_k}", lambda s, d, m=_m: rounded(posterior.doc_l1(m(s, d))), f"{_w} SELECT doc_id, l1, any_value(n1)::BIGINT AS n, round(any_value(l1_p), 6) AS p FROM mix GROUP BY doc_id, l1")
    _add(f"l2_mixture_{_k}", lambda s, d, m=_m: rounded(posterior.doc_l2(m(s, d))), f"{_w} SELECT doc_id, l1, l2, n, round(l2_p, 6) AS p FROM mix")
    _add(f"phi_{_k}", lambda s, d, m=_m: rounded(posterior.phi(m(s, d)).drop("l1", "l2"), 10), f"{_p} SELECT word, z, n, round(p, 10) AS p FROM phi")
    _long = f"doc_id, {Q.topic()} AS topic, round(l1_p, 10) AS prob" if _k == "lda" else f"doc_id, {Q.topic(_topic)} AS topic, {Q.sentiment(_sent)} AS sentiment, {Q.topic('l1') if _k == 'rjst' else Q.sentiment('l1')} || '_' || {Q.sentiment('l2') if _k == 'rjst' else Q.topic('l2')} AS sentopic, round(l1_p, 10) AS l1_prob, round(l2_p, 10) AS l2_prob, round(p, 10) AS prob"
    _add(f"melt_{_k}", lambda s, d, m=_m: rounded(summary.melt(m(s, d)), 10), f"{_w} SELECT {_long} FROM mix")
    _add(f"integrity_flags_{_k}", lambda s, d, m=_m: posterior.integrity(m(s, d)), "SELECT true AS za, true AS toks, true AS lex, true AS l1, true AS l2, true AS phi")

_add(
    "melt_docvars",
    lambda s, d: rounded(summary.melt(X.lda(s, d), include_docs=True)),
    f"{Q.model()} SELECT doc_id, {Q.topic()} AS topic, round(l1_p, 6) AS prob, date, round(sentiment, 6) AS sentiment FROM mix JOIN docs USING (doc_id)",
)
_add(
    "posterior_inversion",
    lambda s, d: rounded(posterior.l1_counts(posterior.doc_l1(m := X.lda(s, d)), posterior.count_zd(m).groupBy("doc_id").agg(F.sum("n").alias("length")), m.l1_prior)),
    f"{Q.model()} SELECT doc_id, l1, round(n1::DOUBLE, 6) AS n FROM mix WHERE doc_id IN (SELECT doc_id FROM zd)",
)

# ---- top words -------------------------------------------------------------------------------------------------------


def _ranked(kind: str, method: str) -> str:
    """Cells (word, z, value) of a method."""
    w = Q.model(kind) + Q.phi(kind)
    if method == "frequency":
        return w + ", r AS (SELECT word, z, n::DOUBLE AS value, (sum(n) OVER (PARTITION BY word))::DOUBLE AS overall FROM cell)"
    if method == "probability":
        return w + ", r AS (SELECT word, z, p AS value FROM phi)"
    if method == "term-score":
        return w + ", v AS (SELECT word, z, p + 2.220446049250313e-16 AS v FROM phi), r AS (SELECT word, z, round(v * (ln(v) - avg(ln(v)) OVER (PARTITION BY word)), 12) AS value FROM v)"
    return w + """, e AS (SELECT word, z, round(p, 12) AS p, round(p / sum(p) OVER (PARTITION BY word), 12) AS x FROM phi),
f AS (SELECT word, z, (rank() OVER (PARTITION BY z ORDER BY p) + (count(*) OVER (PARTITION BY z, p) - 1) / 2.0e0) / count(*) OVER (PARTITION BY z) AS fp,
  (rank() OVER (PARTITION BY z ORDER BY x) + (count(*) OVER (PARTITION BY z, x) - 1) / 2.0e0) / count(*) OVER (PARTITION BY z) AS fx FROM e),
r AS (SELECT word, z, 1 / (0.5e0 / fx + 0.5e0 / fp) AS value FROM f)"""


def _top(kind: str, method: str, n: int = 10, subset: str = "true") -> str:
    L2 = {"lda": 1, "rjst": 3, "jst": 5}[kind]
    t, x = (f"(z % {L2})", f"(z // {L2})") if kind == "jst" else (f"(z // {L2})", f"(z % {L2})")
    named = f"{Q.topic(t)} AS topic" + ("" if kind == "lda" else f", {Q.sentiment(x + '::INT')} AS sentiment")
    extra = ", round(overall, 8) AS overall" if method == "frequency" else ""
    return f"""{_ranked(kind, method)}, b AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY value DESC, word)::INT AS rank FROM r QUALIFY rank <= {n})
SELECT {named}, rank, word, round(value, 8) AS value{extra} FROM b WHERE {subset.replace('topic', f'({t} + 1)').replace('sentiment', f'({x} + 1)')}"""


for _method in summary.METHODS:
    _add(f"top_words_{_method.replace('-', '_')}", lambda s, d, x=_method: rounded(summary.top_words(X.lda(s, d), method=x), 8), _top("lda", _method))
    _add(f"top_words_{_method.replace('-', '_')}_rjst", lambda s, d, x=_method: rounded(summary.top_words(X.rjst(s, d), method=x), 8), _top("rjst", _method))
_add("top_words_jst", lambda s, d: rounded(summary.top_words(X.jst(s, d)), 8), _top("jst", "frequency"))
_add("top_words_subset", lambda s, d: rounded(summary.top_words(X.rjst(s, d), method="probability", subset="topic <= 2 and sentiment = 3"), 8), _top("rjst", "probability", subset="topic <= 2 and sentiment = 3"))
_add(
    "top_words_matrix",
    lambda s, d: summary.top_words_matrix(X.lda(s, d)),
    f"{_ranked('lda', 'frequency')}, b AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY value DESC, word)::INT AS rank FROM r QUALIFY rank <= 10) SELECT rank, "
    + ", ".join(f"max(word) FILTER (WHERE z = {z}) AS topic{z + 1}" for z in range(5))
    + " FROM b GROUP BY rank",
)
_add(
    "representative_docs",
    lambda s, d: rounded(summary.representative_docs(X.rjst(s, d), topic=0, sentiment=2, n=3)),
    f"{Q.model('rjst')}, b AS (SELECT doc_id, p FROM mix WHERE l1 = 0 AND l2 = 2 ORDER BY p DESC, doc_id LIMIT 3) SELECT b.doc_id, round(any_value(p), 6) AS prob, string_agg(word, ' ' ORDER BY pos) AS text FROM b LEFT JOIN tok ON tok.doc_id = b.doc_id GROUP BY b.doc_id",
)
_SUN = f"""{Q.model('rjst')}{Q.phi('rjst')},
a1 AS (SELECT l1, avg(l1_p) AS v FROM mix WHERE l2 = 0 GROUP BY l1), a2 AS (SELECT l1, l2, z, avg(p) AS v FROM mix GROUP BY ALL),
a3 AS (SELECT word, z, p, p / sum(p) OVER (PARTITION BY z) AS share FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY p DESC, word) AS r FROM phi) WHERE r <= 5)
SELECT {Q.topic()} AS id, '' AS parent, {Q.topic()} AS label, 1 AS level, round(v, 6) AS value, round(v, 6) AS real FROM a1
UNION ALL SELECT {Q.topic('a2.l1')} || '/' || {Q.sentiment('l2')}, {Q.topic('a2.l1')}, {Q.sentiment('l2')}, 2, round(a2.v, 6), round(a2.v / a1.v, 6) FROM a2 JOIN a1 USING (l1)
UNION ALL SELECT {Q.topic('l1')} || '/' || {Q.sentiment('l2')} || '/' || word, {Q.topic('l1')} || '/' || {Q.sentiment('l2')}, word, 3, round(share * 0.9e0 * v, 6), round(p, 6) FROM a3 JOIN a2 USING (z)"""
_add("sunburst", lambda s, d: rounded(summary.sunburst(X.rjst(s, d))), _SUN)
_add(
    "ldavis_term_frequency",
    lambda s, d: summary.ldavis_tables(X.lda(s, d))["term_frequency"],
    f"WITH {Q.TOKENS} SELECT word, count(*) AS term_frequency FROM tok GROUP BY word",
)

# ---- windows and coherence -------------------------------------------------------------------------------------------

_TOPW = """, topw AS (SELECT z, word FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY p DESC, word) AS r FROM phi) WHERE r <= 10)"""


def _pairs(window: int, full: bool) -> str:
    """..., np (w1, w2, v): NPMI of pairs of top words, or of top words with all words: every window is a row here."""
    right = "ww" if full else "tw"
    return f"""{Q.model("lda")}{Q.phi()}{_TOPW},
ln AS (SELECT doc_id, max(pos) + 1 AS n FROM tok GROUP BY doc_id), nw AS (SELECT sum(greatest(1, n - {window} + 1)) AS w FROM ln),
ww AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, least(pos - {window} + 1, greatest(0, least(pos, n - {window}))))::BIGINT, greatest(0, least(pos, n - {window}))::BIGINT + 1)) AS st, word
  FROM tok JOIN ln USING (doc_id) {"" if full else "WHERE word IN (SELECT word FROM topw)"}),
tw AS (SELECT * FROM ww WHERE word IN (SELECT word FROM topw)), sg AS (SELECT word, count(*) AS c FROM ww GROUP BY word),
bo AS (SELECT a.word AS w1, b.word AS w2, count(*) AS c FROM tw a JOIN {right} b ON a.doc_id = b.doc_id AND a.st = b.st GROUP BY ALL),
pr AS (SELECT w1, w2, x.c / w AS p1, y.c / w AS p2, bo.c / w AS p12 FROM bo JOIN sg x ON x.word = w1 JOIN sg y ON y.word = w2 CROSS JOIN nw),
np AS (SELECT w1, w2, p1, p2, p12, CASE WHEN p12 >= 1 THEN 1 ELSE ln(p12 / (p1 * p2)) / -ln(p12) END AS v FROM pr)"""


_add(
    "virtual_documents",
    lambda s, d: corpus.virtual_documents(X.tokens(s, d), 10).select("doc_id", "start", F.size("words").alias("n"), F.array_join("words", " ").alias("words")),
    f"""WITH {Q.TOKENS}, w AS (SELECT doc_id, pos, list(word) OVER f AS ws, count(*) OVER (PARTITION BY doc_id) AS n FROM tok WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT doc_id, pos AS start, len(ws)::INT AS n, array_to_string(ws, ' ') AS words FROM w WHERE pos = 0 OR pos <= n - 10""",
)
_add(
    "cooccurrence_npmi",
    lambda s, d: rounded(coherence.npmi(coherence.cooccurrence((m := X.lda(s, d)).tokens, 10, summary.top_word_index(m).select("word").distinct()))),
    f"{_pairs(10, False)} SELECT w1, w2, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p12, 6) AS p12, round(v, 6) AS npmi FROM np",
)
_add(
    "coherence_npmi",
    lambda s, d: rounded(coherence.coherence(X.lda(s, d), method="C_NPMI")),
    f"{_pairs(10, False)} SELECT a.z, a.z AS l1, 0 AS l2, round(avg(coalesce(v, -1)), 6) AS value FROM topw a JOIN topw b ON a.z = b.z AND a.word < b.word LEFT JOIN np ON w1 = a.word AND w2 = b.word GROUP BY a.z",
)
_add(
    "coherence_cv",
    lambda s, d: rounded(coherence.coherence(X.lda(s, d), method="C_V")),
    f"""{_pairs(110, True)},
g AS (SELECT topw.z, topw.word AS w1, lexv.word AS w2, coalesce(v, -1) AS a FROM topw CROSS JOIN lexv LEFT JOIN np ON np.w1 = topw.word AND np.w2 = lexv.word),
s AS (SELECT z, w2, sum(a) AS b FROM g GROUP BY ALL),
c AS (SELECT g.z, w1, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS c FROM g JOIN s USING (z, w2) GROUP BY ALL)
SELECT z, z AS l1, 0 AS l2, round(avg(c), 6) AS value FROM c GROUP BY z""",
)

# ---- likelihood ------------------------------------------------------------------------------------------------------


_add(
    "loglik_w",
    lambda s, d: posterior.loglik_words(X.lda(s, d)).select("z", F.round("value", 3).alias("w")),
    f"{Q.model()}{Q.phi()} SELECT z, round(sum(lgamma(n + beta + 1e-9) - lgamma(beta + 1e-9)) + lgamma(sum(beta)) - lgamma(sum(n) + sum(beta)), 3) AS w FROM cell GROUP BY z",
)
_add(
    "loglik_l1",
    lambda s, d: posterior.loglik_l1(X.lda(s, d)).agg(F.round(F.sum("value"), 4).alias("loglik")),
    f"{Q.model()}, p AS (SELECT doc_id, sum(lgamma(n + 1e0)) - lgamma(sum(n) + 5e0) + lgamma(5e0) - 5 * lgamma(1e0) AS v FROM mix GROUP BY doc_id) SELECT round(sum(v), 4) AS loglik FROM p",
)
_add(
    "loglik_l2",
    lambda s, d: posterior.loglik_l2(X.rjst(s, d)).groupBy("l1").agg(F.round(F.sum("value"), 4).alias("loglik")),
    f"{Q.model('rjst')}, p AS (SELECT l1, doc_id, sum(lgamma(n + 5e0)) - lgamma(sum(n) + 15e0) + lgamma(15e0) - 3 * lgamma(5e0) AS v FROM mix GROUP BY ALL) SELECT l1, round(sum(v), 4) AS loglik FROM p GROUP BY l1",
)

# ---- chains ----------------------------------------------------------------------------------------------------------


def _chain_phi(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(posterior.phi(X.lda(s, d, factors=f)).select("word", "z", "p") for f in ((7919, 104729), (15485863, 32452843)))


def _two(end: str) -> str:
    a, b = Q.model() + Q.phi(), Q.model(factors=(15485863, 32452843)) + Q.phi()
    return f"WITH pa AS ({a} SELECT word, z, p FROM phi), pb AS ({b} SELECT word, z, p FROM phi) {end}"


_DIST = {
    "euclidean": "sqrt(sum((pa.p - pb.p) * (pa.p - pb.p)))",
    "hellinger": "sqrt(sum((sqrt(pa.p) - sqrt(pb.p)) * (sqrt(pa.p) - sqrt(pb.p)))) / sqrt(2)",
    "cosine": "1 - sum(pa.p * pb.p) / sqrt(sum(pa.p * pa.p) * sum(pb.p * pb.p))",
}
for _method, _d in _DIST.items():
    _leafs = f", d AS (SELECT pa.z AS i, pb.z AS j, {_d} AS d FROM pa JOIN pb ON pa.word = pb.word GROUP BY ALL)"
    _add(f"leaf_distances_{_method}", lambda s, d, x=_method: rounded(chains.leaf_distances(*_chain_phi(s, d), x), 8), _two(_leafs + " SELECT i, j, round(d, 8) AS d FROM d"))

    def _assigned(s: SparkSession, d: str, x: str = _method) -> DataFrame:
        a, b = _chain_phi(s, d)
        return s.createDataFrame([(round(chains.distance(X.lda(s, d), a, b, x), 8),)], "distance double")

    _perm = " CROSS JOIN ".join(f"d d{i}" for i in range(5))
    _where = " AND ".join([f"d{i}.i = {i}" for i in range(5)] + [f"d{i}.j <> d{j}.j" for i in range(5) for j in range(i)])
    _add(f"chain_{_method}", _assigned, _two(_leafs + f" SELECT round(min({' + '.join(f'd{i}.d' for i in range(5))}), 8) AS distance FROM {_perm} WHERE {_where}"))
_add("chain_naive_euclidean", lambda s, d: rounded(chains.naive_distance(*_chain_phi(s, d)), 8), _two(", n AS (SELECT sqrt(sum((pa.p - pb.p) * (pa.p - pb.p))) AS d FROM pa JOIN pb ON pa.word = pb.word AND pa.z = pb.z GROUP BY pa.z) SELECT round(sum(d), 8) AS distance FROM n"))
_add(
    "chain_min_max",
    lambda s, d: rounded(chains.min_max_distance(chains.leaf_distances(*_chain_phi(s, d), "euclidean")), 8),
    _two(f", d AS (SELECT pa.z AS i, pb.z AS j, {_DIST['euclidean']} AS d FROM pa JOIN pb ON pa.word = pb.word GROUP BY ALL) SELECT round(greatest((SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY i)), (SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY j))), 8) AS distance"),
)

# ---- sentiment -------------------------------------------------------------------------------------------------------

_POS = {"proportional": "{p} - {n}", "proportionalPol": "({p} - {n}) / ({p} + {n})"}


def _topic_sentiment(method: str = "proportional") -> str:
    v = _POS[method].format(p="max(p) FILTER (WHERE l2 = 2)", n="max(p) FILTER (WHERE l2 = 0)")
    return f"{Q.model('rjst')}, ts AS (SELECT doc_id, l1, {v} AS s, max(l1_p) AS theta FROM mix GROUP BY doc_id, l1), sen AS (SELECT doc_id, sum(s * theta) AS sentiment FROM ts GROUP BY doc_id)"


for _method in sentiment.METHODS:
    _v = _POS[_method].format(p="max(l1_p) FILTER (WHERE l1 = 2)", n="max(l1_p) FILTER (WHERE l1 = 0)")
    _add(f"sentiment_jst_{_method.lower()}", lambda s, d, x=_method: rounded(sentiment.document_sentiment(X.jst(s, d), x)), f"{Q.model('jst')} SELECT doc_id, round({_v}, 6) AS sentiment FROM mix GROUP BY doc_id")
    _add(f"sentiment_rjst_{_method.lower()}", lambda s, d, x=_method: rounded(sentiment.document_sentiment(X.rjst(s, d), x)), f"{_topic_sentiment(_method)} SELECT doc_id, round(sentiment, 6) AS sentiment FROM sen")
    _add(f"topic_sentiment_{_method.lower()}", lambda s, d, x=_method: rounded(sentiment.topic_sentiment(X.rjst(s, d), x)), f"{_topic_sentiment(_method)} SELECT doc_id, l1 AS topic, round(s, 6) AS s, round(theta, 6) AS theta FROM ts")

# ---- series ----------------------------------------------------------------------------------------------------------


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.proportion_topics(X.lda(spark, sf_dir), "month"))


def _floor(period: str) -> str:
    return f"date_trunc('{period}', date)::DATE"


def _series(period: str, name: str = "ser") -> str:
    return f"{name} AS (SELECT {_floor(period)} AS date, avg(sentiment) AS value FROM docs GROUP BY 1)"


_SEL = "SELECT date, round(value, 6) AS value FROM"
_SELT = "SELECT date, topic, round(value, 6) AS value FROM"
for _period in series.PERIODS:
    _add(f"sentiment_series_{_period}", lambda s, d, x=_period: rounded(series.sentiment_series(X.lda(s, d), x, scale=False)), f"WITH {Q.TOKENS}, {_series(_period)} {_SEL} ser")
_add("sentiment_series_rolling", lambda s, d: rounded(series.sentiment_series(X.lda(s, d), "month", 3, scale=False)), f"WITH {Q.TOKENS}, {_series('month')} {_SEL} ({Q.rolled('ser', 'month', 3, '')})")
_add("sentiment_series_rolling_day", lambda s, d: rounded(series.sentiment_series(X.lda(s, d), "day", 30, scale=False)), f"WITH {Q.TOKENS}, {_series('day')} {_SEL} ({Q.rolled('ser', 'day', 30, '')})")
_SCALED = f"{_series('month')}, rol AS ({Q.rolled('ser', 'month', 3, '')}), par AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM rol)"
_add("sentiment_series_scaled", lambda s, d: rounded(series.sentiment_series(X.lda(s, d), "month", 3)), f"WITH {Q.TOKENS}, {_SCALED} SELECT date, round((value - m) / s, 6) AS value FROM rol CROSS JOIN par")
_add("sentiment_scaled_documents", lambda s, d: rounded(series.scaled_sentiment(X.lda(s, d), "month", 3)), f"WITH {Q.TOKENS}, {_SCALED} SELECT doc_id, round((sentiment - m) / s, 6) AS sentiment FROM docs CROSS JOIN par")
_add("sentiment_series_rjst", lambda s, d: rounded(series.sentiment_series(X.rjst(s, d), "month", scale=False), 8), f"{_topic_sentiment()} SELECT {_floor('month')} AS date, round(avg(sen.sentiment), 8) AS value FROM sen JOIN docs USING (doc_id) GROUP BY 1")

_LDA_PARTS = f"{Q.model()}, pt AS (SELECT doc_id, l1, l1_p AS theta, sentiment AS s FROM mix JOIN docs USING (doc_id))"
_RJST_PARTS = f"{_topic_sentiment()}, pt AS (SELECT doc_id, l1, theta, s FROM ts)"
_BREAK = ", br AS (SELECT {f} AS date, {t} AS topic, avg(s * theta) AS value FROM pt JOIN docs USING (doc_id) GROUP BY ALL), al AS (SELECT * FROM br UNION ALL SELECT date, 'sentiment', sum(value) FROM br GROUP BY date)"
for _name, _parts, _m in (("", _LDA_PARTS, X.lda), ("_rjst", _RJST_PARTS, X.rjst)):
    _b = _parts + _BREAK.format(f=_floor("month"), t=Q.topic())
    _t = _parts + f", al AS (SELECT {_floor('month')} AS date, {Q.topic()} AS topic, sum(s * theta) / sum(theta) AS value FROM pt JOIN docs USING (doc_id) GROUP BY ALL)"
    _i = f"{_parts} SELECT doc_id, date, {Q.topic()} AS topic, round(s * theta, 6) AS value FROM pt JOIN docs USING (doc_id)"
    _add(f"sentiment_breakdown{_name}", lambda s, d, m=_m: rounded(series.sentiment_breakdown(m(s, d), "month")), f"{_b} {_SELT} al")
    _add(f"sentiment_breakdown_rolling{_name}", lambda s, d, m=_m: rounded(series.sentiment_breakdown(m(s, d), "month", 6)), f"{_b} {_SELT} ({Q.rolled('al', 'month', 6)})")
    _add(f"sentiment_breakdown_identity{_name}", lambda s, d, m=_m: rounded(series.sentiment_breakdown(m(s, d), "identity")), _i)
    _add(f"sentiment_topics{_name}", lambda s, d, m=_m: rounded(series.sentiment_topics(m(s, d), "month")), f"{_t} {_SELT} al")
    _add(f"sentiment_topics_rolling{_name}", lambda s, d, m=_m: rounded(series.sentiment_topics(m(s, d), "month", 3)), f"{_t} {_SELT} ({Q.rolled('al', 'month', 3)})")
    _add(f"sentiment_topics_identity{_name}", lambda s, d, m=_m: rounded(series.sentiment_topics(m(s, d), "identity")), _i)
_add(
    "sentiment_topics_scaled",
    lambda s, d: rounded(series.sentiment_topics(X.lda(s, d), "month", scale=True)),
    f"{_LDA_PARTS}, {_series('month')}, par AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM ser) SELECT {_floor('month')} AS date, {Q.topic()} AS topic, round(sum((s - m) / sd * theta) / sum(theta), 6) AS value FROM pt JOIN docs USING (doc_id) CROSS JOIN par GROUP BY 1, l1",
)
_PROP = f"{Q.model()}, al AS (SELECT {_floor('month')} AS date, {Q.topic()} AS topic, avg(l1_p) AS value FROM mix JOIN docs USING (doc_id) GROUP BY ALL)"
_add("proportion_topics", proportions, f"{_PROP} {_SELT} al")
_add("proportion_topics_rolling", lambda s, d: rounded(series.proportion_topics(X.lda(s, d), "month", 3)), f"{_PROP} {_SELT} ({Q.rolled('al', 'month', 3)})")
_LEAF = {"rjst": f"{Q.topic('l1')} || '_' || {Q.sentiment('l2')}", "jst": f"{Q.sentiment('l1')} || '_' || {Q.topic('l2')}"}
for _k in ("rjst", "jst"):
    _add(f"proportion_topics_leaf_{_k}", lambda s, d, m=_MODELS[_k]: rounded(series.proportion_topics(m(s, d), "quarter")), f"{Q.model(_k)} SELECT {_floor('quarter')} AS date, {_LEAF[_k]} AS topic, round(avg(p), 6) AS value FROM mix JOIN docs USING (doc_id) GROUP BY ALL")
    _first = Q.topic("l1") if _k == "rjst" else Q.sentiment("l1")
    _add(f"proportion_topics_first_{_k}", lambda s, d, m=_MODELS[_k]: rounded(series.proportion_topics(m(s, d), "quarter", complete=False)), f"{Q.model(_k)} SELECT {_floor('quarter')} AS date, {_first} AS topic, round(avg(l1_p), 6) AS value FROM mix JOIN docs USING (doc_id) WHERE l2 = 0 GROUP BY ALL")
_add("proportion_topics_identity", lambda s, d: rounded(series.proportion_topics(X.lda(s, d), "identity")), f"{Q.model()} SELECT doc_id, date, {Q.topic()} AS topic, round(l1_p, 6) AS value FROM mix JOIN docs USING (doc_id)")
_add(
    "proportion_topics_wide",
    lambda s, d: rounded(series.wide(series.proportion_topics(X.lda(s, d), "month"), list(X.lda(s, d).topic_labels))),
    f"{_PROP} SELECT date, " + ", ".join(f"round(max(value) FILTER (WHERE topic = 'topic{i}'), 6) AS topic{i}" for i in range(1, 6)) + " FROM al GROUP BY date",
)
_add(
    "breakdown_plot_table",
    lambda s, d: rounded(series.plot_table(series.sentiment_breakdown(X.lda(s, d), "day"), "day", ridgeline=True)),
    f"""{_LDA_PARTS}{_BREAK.format(f=_floor('day'), t=Q.topic())}, cal AS (SELECT t.d::DATE AS date, topic FROM (SELECT unnest(generate_series((SELECT min(date) FROM al)::TIMESTAMP, (SELECT max(date) FROM al)::TIMESTAMP, INTERVAL 1 day)) AS d) t CROSS JOIN (SELECT DISTINCT topic FROM al)),
fil AS (SELECT cal.date, cal.topic, last_value(value IGNORE NULLS) OVER (PARTITION BY cal.topic ORDER BY cal.date) AS value FROM cal LEFT JOIN al ON al.date = cal.date AND al.topic = cal.topic)
SELECT date, topic, round(value, 6) AS value, 1::INT AS width, date AS centre, round(value / max(abs(value)) OVER (), 6) AS height FROM fil""",
)

# ---- merging ---------------------------------------------------------------------------------------------------------

_GROUPS = {"theme1": [1, 5], "theme2": [2, 3, 4]}
_MAP = "CASE WHEN {z} IN (0, 4) THEN 0 ELSE 1 END"


def _merged(s: SparkSession, d: str) -> TopicModel:
    return merging.merge_topics(X.lda(s, d), _GROUPS)


_add("merge_topics_theta", lambda s, d: rounded(posterior.doc_l1(_merged(s, d))), f"{Q.model()} SELECT doc_id, ({_MAP.format(z='l1')})::INT AS l1, sum(n)::BIGINT AS n, round(sum(l1_p), 6) AS p FROM mix GROUP BY doc_id, 2")
_MPHI = f"{Q.model()}{Q.phi()}, mg AS (SELECT word, {_MAP.format(z='z')} AS z, sum(n) AS n, sum(beta) AS beta FROM cell GROUP BY ALL), mp AS (SELECT word, z, (n + beta) / (sum(n) OVER (PARTITION BY z) + sum(beta) OVER (PARTITION BY z)) AS p, n FROM mg)"
_add("merge_topics_phi", lambda s, d: rounded(posterior.phi(_merged(s, d)).drop("l1", "l2"), 10), f"{_MPHI} SELECT word, z::INT AS z, n::BIGINT AS n, round(p, 10) AS p FROM mp")
_add(
    "merge_topics_top_words",
    lambda s, d: rounded(summary.top_words(_merged(s, d), method="probability"), 8),
    f"{_MPHI} SELECT 'theme' || (z + 1) AS topic, row_number() OVER (PARTITION BY z ORDER BY p DESC, word)::INT AS rank, word, round(p, 8) AS value FROM mp QUALIFY rank <= 10",
)
_add(
    "merge_topics_sentiment_rjst",
    lambda s, d: rounded(sentiment.document_sentiment(merging.merge_topics(X.rjst(s, d), _GROUPS))),
    f"""{Q.model('rjst')}, g AS (SELECT doc_id, {_MAP.format(z='l1')} AS t, l2, sum(n) AS n, count(*) AS k FROM mix GROUP BY doc_id, 2, l2),
h AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, t) AS n1, sum(n) OVER (PARTITION BY doc_id) AS tot FROM g),
m AS (SELECT doc_id, t, l2, (n1 + k) / (tot + 5e0) AS theta, (n + 5e0 * k) / (n1 + 15e0 * k) AS pi FROM h)
SELECT doc_id, round(sum(theta * theta * (pp - pn)), 6) AS sentiment FROM (SELECT doc_id, t, max(theta) AS theta, max(pi) FILTER (WHERE l2 = 2) AS pp, max(pi) FILTER (WHERE l2 = 0) AS pn FROM m GROUP BY doc_id, t) GROUP BY doc_id""",
)

# ---- estimation, no SQL twin -----------------------------------------------------------------------------------------


def _fitted(s: SparkSession, d: str) -> DataFrame:
    """Document mixtures after a few sweeps over the whole corpus."""
    m = gibbs.fit(gibbs.start(X.lda(s, d)), iterations=10, likelihood=False)
    return posterior.doc_l1(m)


def _recovery(s: SparkSession, d: str) -> DataFrame:
    """Distance of estimated to generating topics, which tests hold against .15; generated texts, not the tables'."""
    vocab = synth.generate_vocabulary(s, topics=5, sentiments=1)
    tokens = synth.generate_documents(s, vocab, n=100, words=100).select("doc_id", "pos", "word")
    words = tokens.select("word").distinct().withColumn("lex", F.lit(None).cast("string"))
    m = gibbs.fit(gibbs.start(TopicModel("lda", tokens.select("doc_id").distinct(), tokens.withColumn("z", F.lit(0)), words, K=5)), iterations=60, likelihood=False)
    truth = synth.true_phi(vocab, 1)
    return s.createDataFrame([(chains.distance(m, posterior.phi(m).select("word", "z", "p"), truth, "euclidean"),)], "distance double")


_add("gibbs_fit", _fitted)
_add("synthetic_recovery", _recovery)


def queries() -> dict[str, Query]:
    return _QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | more.SQL
