"""Scores as Column expressions. `now` is always a parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and constants of the rankings.
BM25_WEIGHTS = {"title": 4.0, "tags": 3.0, "breadcrumb": 2.0, "body": 1.0}
BM25_K1, BM25_B, BM25_MIN_IDF = 1.2, 0.75, 1e-6
SUBSTRING_WEIGHTS = {"body": 1, "breadcrumb": 2, "title": 3}
RRF_K = 60
TIER_PRIOR = {"durable": 1.00, "journal": 0.90, "episode": 0.65}
USAGE_HALF_LIFE_DAYS, USAGE_SATURATION, USAGE_BOOST = 30.0, 20, 0.25
MIN_SIMILARITY = 0.30


def overlapping_count(text: Column, term: Column) -> Column:
    """How often `term` stands in `text`, overlapping places included. The term is taken literally."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.regexp_count(text, quoted)


def bm25_idf(n_docs: Column, n_with: Column) -> Column:
    raw = F.log((n_docs - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, F.lit(BM25_MIN_IDF)).otherwise(raw)


def bm25_term(idf: Column, frequency: Column, length: Column, mean_length: Column) -> Column:
    """One term's part of the score; less is better."""
    return -idf * frequency * (BM25_K1 + 1) / (frequency + BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length))


def rrf_part(rank: Column) -> Column:
    """What a place (from 1) in one ranking adds."""
    return 1.0 / (RRF_K + rank)


def tier_prior(tier: Column) -> Column:
    out = F.lit(1.0)
    for name, value in TIER_PRIOR.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def age_days(now: float, then: Column) -> Column:
    return (F.lit(float(now)) - then) / F.lit(86400.0)


def usage_score(uses: Column, last_used: Column, pinned: Column, now: float) -> Column:
    """1 if pinned, 0 if never used, else how often, saturating at 20 uses, halved every 30 days."""
    often = F.least(F.lit(1.0), F.log1p(uses.cast("double")) / F.lit(math.log1p(USAGE_SATURATION)))
    fresh = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days(now, last_used)) / F.lit(USAGE_HALF_LIFE_DAYS))
    used = (F.coalesce(uses, F.lit(0)) > 0) & (F.coalesce(last_used, F.lit(0.0)) > 0)
    return F.when(F.coalesce(pinned, F.lit(0)) != 0, F.lit(1.0)).when(used, often * fresh).otherwise(F.lit(0.0))


def usage_boost(score: Column, usage: Column) -> Column:
    return score * (1 + F.lit(USAGE_BOOST) * F.coalesce(usage, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in DOUBLE; 0 for vectors of different length, empty or zero ones and null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.coalesce(F.when(ok, dot(a, b) / norms), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller set that the other holds; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))
