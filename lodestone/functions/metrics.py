"""Evaluation and training metrics as aggregate and scalar columns."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_per_byte(loss: Column, n_bytes: Column) -> Column:
    """Nats of the tokens that have bytes, over the bits of all bytes; infinite without bytes."""
    total = F.sum(F.when(n_bytes > 0, n_bytes))
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.sum(F.when(n_bytes > 0, loss)) / (F.lit(log(2)) * total)).otherwise(F.lit(float("inf")))


def average(*values: Column) -> Column:
    """Mean of several figures, as of the bits per byte of two corpora."""
    return sum(values[1:], values[0]) / len(values)


def masked_mean(loss: Column, valid: Column) -> Column:
    return F.coalesce(F.sum(F.when(valid, loss)), F.lit(0.0)) / (F.coalesce(F.sum(valid.cast("int")), F.lit(0)) + F.lit(1e-9))


def accuracy(correct: Column) -> Column:
    """Mean of a boolean, 0 without rows."""
    return F.coalesce(F.avg(correct.cast("double")), F.lit(0.0))


def first_least(choice: Column, loss: Column, length: Column) -> Column:
    """The choice of least mean loss; a NaN comes before all, the first of equals wins."""
    mean = loss.cast("double") / length
    return F.min_by(choice, F.struct(F.when(F.isnan(mean) | mean.isNull(), F.lit(float("-inf"))).otherwise(mean), choice))


def all_match(predicted: Column, target: Column, valid: Column) -> Column:
    """Whether every valid target was predicted; true without any."""
    return F.coalesce(F.bool_and(F.when(valid, predicted.eqNullSafe(target))), F.lit(True))


def centered(value: Column, baseline_percent: Column) -> Column:
    b = baseline_percent * 0.01
    return (value - b) / (1.0 - b)


def preference(chosen: Column, rejected: Column, chosen_ref: Column, rejected_ref: Column, beta: float) -> dict[str, Column]:
    """Per pair: loss (squared distance of the log-ratio from 1 / 2 beta), rewards, margin, correct."""
    c, r = chosen - chosen_ref, rejected - rejected_ref
    x = c - r
    return {"loss": (x - 1.0 / (2.0 * beta)) * (x - 1.0 / (2.0 * beta)), "chosen_reward": beta * c, "rejected_reward": beta * r, "margin": beta * c - beta * r, "correct": x > 0}


def compression_ratio(text: Column, n_tokens: Column) -> Column:
    """Bytes a token; null without tokens."""
    return F.try_divide(F.octet_length(text), n_tokens)


def relative_difference(base: Column, ours: Column) -> Column:
    """Percent of the base by which ours is shorter."""
    return (base - ours) / base * 100


def learning_rate(step: Column, steps: int, warmup: float = 0.0, warmdown: float = 0.4, final: float = 0.0) -> Column:
    """Multiplier that rises linearly over the first share of the steps, is 1, and falls linearly over the last."""
    up, down = round(warmup * steps), round(warmdown * steps)
    progress = (steps - step) / F.lit(float(max(down, 1)))
    return F.when(step < up, (step + 1) / F.lit(float(max(up, 1)))).when(step <= steps - down, F.lit(1.0)).otherwise(progress + (1 - progress) * final)


def late_decay(step: Column, steps: int, share: float = 0.7, slope: float = 0.7) -> Column:
    """1 until a share of the steps is done, then 1 minus the rest over slope."""
    p = step / F.lit(float(steps))
    return F.when(p < share, F.lit(1.0)).otherwise(1 - (p - share) / slope)


def training_steps(tokens_per_parameter: float, parameters: int | Column, tokens_per_step: int | Column) -> int | Column:
    """Steps that a data ratio asks for, and one more, for numbers or columns."""
    if isinstance(parameters, Column) or isinstance(tokens_per_step, Column):
        return F.ceil(F.floor(tokens_per_parameter * parameters) / tokens_per_step) + 1
    return -(-int(tokens_per_parameter * parameters) // tokens_per_step) + 1


def linear_decay(step: Column, steps: int) -> Column:
    return 1 - step / F.lit(float(steps))


def throughput(tokens: Column, seconds: Column) -> Column:
    """Whole tokens a second."""
    return F.floor(tokens / seconds)


def flops_per_token(parameters: int | Column, embedding: int | Column, layers: int | Column, heads: int | Column, head_dim: int | Column, sequence: int | Column) -> int | Column:
    """Forward and backward operations for a token of a dense transformer, for numbers or columns."""
    return 6 * (parameters - embedding) + 12 * layers * heads * head_dim * sequence


def utilisation(tokens_per_second: Column, flops: Column, peak: Column) -> Column:
    """Percent of peak operations."""
    return 100 * flops * tokens_per_second / peak
