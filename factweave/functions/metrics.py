"""Scores of one prediction against one truth, as expressions on normalised texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.text import _col, normalize_text, words


def exact_match(prediction: Column | str, truth: Column | str) -> Column:
    return (normalize_text(prediction) == normalize_text(truth)).cast("int")


def f1_of_words(p: Column | str, t: Column | str) -> Column:
    """F1 of two word lists: overlap counts distinct words, lengths count all of them."""
    p, t = _col(p), _col(t)
    n_p, n_t = F.size(p), F.size(t)
    common = F.size(F.array_intersect(p, t))
    precision, recall = common / n_p, common / n_t
    return (
        F.when((n_p == 0) | (n_t == 0), (n_p == n_t).cast("double"))
        .when(common == 0, F.lit(0.0))
        .otherwise(2 * (precision * recall) / (precision + recall))
    )


def token_f1(prediction: Column | str, truth: Column | str) -> Column:
    return f1_of_words(words(normalize_text(prediction)), words(normalize_text(truth)))
