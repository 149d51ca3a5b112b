"""Queries of the registry against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tests.conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "tokens_bow", "vocabulary", "bow_to_tokens_roundtrip", "keep_features_padded", "html_paragraphs", "lexicon_match", "lexicon_negation", "ngram_scores", "count_zw_rjst", "l1_mixture_jst",
    "l2_mixture_rjst", "phi_lda", "melt_rjst", "integrity_flags_jst", "posterior_inversion", "top_words_frequency", "top_words_term_score", "top_words_frex", "top_words_subset", "top_words_matrix",
    "representative_docs", "sunburst", "virtual_documents", "cooccurrence_npmi", "coherence_npmi", "coherence_cv", "loglik_w", "loglik_l2", "chain_hellinger", "chain_min_max",
    "sentiment_jst_proportionalpol", "sentiment_rjst_proportional", "sentiment_series_rolling", "sentiment_series_scaled", "sentiment_breakdown_rolling_rjst", "sentiment_topics_scaled",
    "proportion_topics_leaf_jst", "proportion_topics_wide", "breakdown_plot_table", "merge_topics_theta", "merge_topics_sentiment_rjst",
]


#: Of the queries in plans/more.py those that the tests of operators say least about.
NAMES += [
    "keep_features_unpadded", "trim_recipe", "import_assignments", "import_mixtures_bag", "rjst_from_lda_lexicon", "recompiled_vocabulary", "integrity_broken", "integrity_detailed", "inverted_l2", "inverted_phi",
    "repaired_margin_documents", "repaired_margin_topics", "loglik_w_rjst", "loglik_l2_jst", "topic_sentiment_conditional", "sentiment_override", "sentiment_series_rolling_median", "sentiment_series_scaling_period", "scaled_topic_sentiment",
    "proportion_plot_quarter", "top_words_plot", "sunburst_layers", "generated_lexicon", "html_main_block", "ngram_scores_per_word",
]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    return c


def plain(rows):
    show = lambda x: "null" if x is None or x != x else f"{float(x):.9g}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, db, name):
    got = __spark_entry__.queries()[name](spark, TINY)
    cur = db.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    assert plain(map(tuple, got.select(*cols).collect())) == plain(cur.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["date", "topic", "value"] and df.count() > 0


def test_every_query_with_sql_is_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
