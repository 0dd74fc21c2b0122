"""Reward columns that need nothing but the completion's own row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.text import FENCE, as_column, bind, finite_number, words

# Tags and phrases the format rewards look for.
THINK_ANSWER_TAGS = ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>")
STEP_PATTERN = r"(?U)(Step \d+:|\A\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def answer_match(completion: Column | str, gold: Column | str) -> Column:
    r"""The last `\boxed{…}` equals the gold answer, as text or number; null for a blank gold."""
    boxed = F.regexp_extract_all(as_column(completion), F.lit(r"\\boxed\{([^{}]*)\}"), 1)
    answer = _compact(F.try_element_at(boxed, F.lit(-1)))
    gold = _compact(as_column(gold))
    same = (answer == gold) | F.coalesce(finite_number(answer) == finite_number(gold), F.lit(False))
    return F.when(gold != "", _flag(F.coalesce(same, F.lit(False))))


def format_reward(completion: Column | str) -> Column:
    """R2: the text opens with a think block followed by an answer block."""
    return _flag(
        as_column(completion).rlike(r"(?s)\A<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>(?=\n|\z)")
    )


def code_format_reward(completion: Column | str, language: str = "cpp") -> Column:
    """As R2, with a code fence inside the answer."""
    return _flag(
        as_column(completion).rlike(
            rf"(?s)\A<think>\n.*?\n</think>\n<answer>\n.*?{FENCE}{language}.*?{FENCE}.*?\n</answer>(?=\n|\z)"
        )
    )


def tag_count_reward(completion: Column | str) -> Column:
    """A quarter for each tag that occurs exactly once."""
    text = as_column(completion)
    parts = [
        F.when(F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit(""))) == len(tag), 0.25).otherwise(0.0)
        for tag in THINK_ANSWER_TAGS
    ]
    return sum(parts[1:], parts[0])


def reasoning_steps_reward(completion: Column | str) -> Column:
    """A third per step phrase, up to 1."""
    return F.least(F.lit(1.0), F.regexp_count(as_column(completion), F.lit(STEP_PATTERN)) / F.lit(3.0))


def cosine_scaled_reward(
    completion: Column | str,
    is_correct: Column | str,
    *,
    min_value_wrong: float = 0.0,
    max_value_wrong: float = -0.5,
    min_value_correct: float = 0.5,
    max_value_correct: float = 1.0,
    max_len: int = 1000,
) -> Column:
    """Cosine from one end of a range to the other over the text length; 1 where correctness is unknown."""
    is_correct = as_column(is_correct)
    cosine = F.cos(F.length(as_column(completion)) / F.lit(float(max_len)) * F.lit(math.pi))
    low = F.when(is_correct, F.lit(min_value_correct)).otherwise(F.lit(max_value_wrong))
    high = F.when(is_correct, F.lit(max_value_correct)).otherwise(F.lit(min_value_wrong))
    return F.when(is_correct.isNull(), F.lit(1.0)).otherwise(low + (high - low) * 0.5 * (cosine + 1.0))


def repetition_penalty_reward(completion: Column | str, n: int = 3, max_penalty: float = -1.0) -> Column:
    """Share of repeated word n-grams times the penalty.

    n-grams are joined to strings: words hold no white space, so that loses nothing, and
    distinct strings go through a hash set where distinct arrays would be compared pairwise.
    """
    if max_penalty > 0:
        raise ValueError(f"a penalty lowers the reward: {max_penalty} is above 0")

    def penalty(tokens: Column) -> Column:
        total = F.size(tokens) - F.lit(n - 1)
        grams = F.transform(
            F.sequence(F.lit(1), total),
            lambda start: F.concat_ws(" ", *[F.element_at(tokens, start + i) for i in range(n)]),
        )
        repeated = 1 - F.size(F.array_distinct(grams)) / total
        return F.when(F.size(tokens) >= n, repeated * max_penalty).otherwise(F.lit(0.0))

    return bind(words(F.lower(as_column(completion))), penalty)


def soft_overlong_punishment(length: Column | str, max_length: int = 16384, cache: int = 4096) -> Column:
    """0 up to `max_length - cache` tokens, then linear down to -1 at `max_length`, -1 beyond."""
    length = as_column(length)
    free = max_length - cache
    return (
        F.when(length <= free, F.lit(0.0))
        .when(length <= max_length, F.try_divide((F.lit(free) - length).cast("double"), F.lit(cache)))
        .otherwise(F.lit(-1.0))
    )
