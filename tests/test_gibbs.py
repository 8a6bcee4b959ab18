"""Topics by Gibbs sampling: they are found, in one block or several, and no token is left out."""

import numpy as np
import pytest

from themeloom.operators import gibbs
from themeloom.plans import topic_queries
from themeloom.registry import QUERIES

TOPICS, OWN = 5, 12


@pytest.fixture(scope="module")
def planted(spark):
    """Docs of one topic each, whose words are 12 of its own; one doc is long, one has a single word."""
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, OWN, 30 if i else 700) + OWN * (i % TOPICS) for i in range(200)] + [np.array([3])]
    bags = [tuple(x.tolist() for x in np.unique(d, return_counts=True)) for d in docs]
    return spark.createDataFrame([(w, [float(x) for x in n]) for w, n in bags], "words array<int>, counts array<double>"), np.bincount(np.concatenate(docs))


@pytest.mark.parametrize("block", [10**6, 900])
def test_planted_topics_are_found_with_every_token(spark, planted, block):
    bags, sizes = planted
    found = gibbs.topic_counts(bags, TOPICS * OWN, TOPICS, 95, block=block)
    counts = np.zeros((TOPICS * OWN, TOPICS), int)
    for r in found.collect():
        counts[r.word, r.topic] += r.n
    assert counts.sum(axis=1).tolist() == sizes.tolist()
    of = counts.reshape(TOPICS, OWN, TOPICS).sum(axis=1)  # planted by found
    assert of.max(axis=1).sum() > 0.75 * of.sum()  # topics may be split or joined, here and there
    top = gibbs.words(found, TOPICS * OWN, TOPICS, 4).collect()
    assert len(top) == TOPICS * 4
    for r in top:
        assert r.score == pytest.approx((counts[r.i, r.topic] + 1 / TOPICS) / (counts[:, r.topic].sum() + OWN))


def test_a_step_keeps_all_counts(planted):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 40, 300)
    b = gibbs.Block(lengths, rng.integers(0, 50, lengths.sum()), 7, 50, [1])
    before = b.counted().reshape(-1, 7).sum(axis=1)
    start = b.topic.copy()
    b.sample(range(3))
    assert (b.counted().reshape(-1, 7).sum(axis=1) == before).all() and (b.topic != start).any() and set(b.topic) <= set(range(7))
    assert sorted(zip(*np.unique(lengths, return_counts=True))) == sorted(zip(*np.unique(np.bincount(b.doc), return_counts=True)))  # one group


def test_sampling_agrees_with_the_exact_posterior():
    """Two docs of two tokens and two topics: all 16 assignments by their exact probability."""
    from itertools import product
    from math import lgamma

    lengths, words, k, v = np.array([2, 2]), np.array([0, 1, 0, 0]), 2, 2
    b = gibbs.Block(lengths, words, k, v, [5])

    def weight(z):
        total = 0.0
        for d in range(2):
            total += sum(lgamma(sum(z[i] == t for i in range(4) if b.doc[i] == d) + 1 / k) for t in range(k))
        for t in range(k):
            total += sum(lgamma(sum(z[i] == t for i in range(4) if b.word[i] == w) + 1 / k) for w in range(v)) - lgamma(sum(x == t for x in z) + v / k)
        return np.exp(total)

    states = list(product(range(k), repeat=4))
    exact = np.array([weight(z) for z in states])
    b.slices = [(i, i + 1, 0) for i in range(4)]  # one token at a time, as the posterior has it
    seen = dict.fromkeys(states, 0)
    for sweep in range(6000):
        b.sample(range(sweep, sweep + 1))
        seen[tuple(b.topic.tolist())] += 1
    assert np.abs(np.array(list(seen.values())) / 6000 - exact / exact.sum()).max() < 0.03


def test_lda_baseline_trains_to_the_end_in_few_jobs(spark, sf):
    spark.sparkContext.setJobGroup("lda", "")
    rows = QUERIES["lda_baseline"](spark, sf).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lda")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert topic_queries.REFERENCE_SWEEPS == 1000 and len(jobs) < 200  # a job or more for each sweep before
    assert len(rows) == 100 * 25 and {r.place for r in rows} == set(range(1, 26)) and all(0 < r.score <= 1 for r in rows)
