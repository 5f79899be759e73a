"""Token models and draft-and-verify decoding inside Arrow tasks.

A model maps a token prefix to a probability row.  Loops are sequential within a prompt, so each prompt is one unit of work
and prompts are the parallel dimension; randomness comes from a generator keyed by (prompt, seed), never by task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "ACGTN"


class NextToken(Protocol):
    """Anything that gives the next token's probabilities after a prefix."""

    def probs(self, prefix: np.ndarray) -> np.ndarray: ...


def row(p: np.ndarray) -> np.ndarray:
    """A proper probability row: no negative mass, sums to one, uniform if there is none."""
    up = np.clip(np.asarray(p, float), 0.0, None)
    mass = up.sum()
    return up / mass if 0 < mass < np.inf else np.full(len(up), 1 / len(up))


@dataclass
class Identity:
    """Proposes what the target would."""

    target: NextToken

    def probs(self, prefix: np.ndarray) -> np.ndarray:
        return self.target.probs(prefix)


@dataclass
class Bigram:
    table: np.ndarray
    start: np.ndarray

    def probs(self, prefix: np.ndarray) -> np.ndarray:
        return row(self.table[prefix[-1]] if len(prefix) else self.start)


@dataclass
class Markov:
    """Rows by context text of k symbols; contexts never seen are uniform.  Tokens are symbol indices."""

    k: int
    rows: dict[str, np.ndarray]

    def probs(self, prefix: np.ndarray) -> np.ndarray:
        ctx = "".join(SYMBOLS[t] for t in prefix[-self.k :]).rjust(self.k, "N")
        return self.rows.get(ctx, np.full(5, 0.2))


@dataclass
class Lookup:
    """Weight on what followed the latest earlier occurrence of the last k tokens; else a fallback, else uniform."""

    k: int = 10
    weight: float = 0.9
    fallback: NextToken | None = None

    def match(self, prefix: np.ndarray) -> tuple[int, int] | None:
        s = bytes(int(t) for t in prefix)
        at = s.rfind(s[len(s) - self.k :], 0, len(s) - 1) if len(s) >= self.k else -1
        return None if at < 0 else (at, s[at + self.k])

    def probs(self, prefix: np.ndarray) -> np.ndarray:
        hit = self.match(prefix)
        if hit is None:
            return self.fallback.probs(prefix) if self.fallback else np.full(5, 0.2)
        out = np.full(5, (1 - self.weight) / 5)
        out[hit[1]] += self.weight
        return out


@dataclass
class Verdict:
    tokens: list[int]
    accepted: int
    corrected: bool
    fallback: bool = False
    winner: int = 0
    mask: list[bool] = field(default_factory=list)


def _rows(p: np.ndarray) -> np.ndarray:
    """``row`` for the last axis of an array of any shape."""
    up = np.clip(np.asarray(p, float), 0.0, None)
    mass = up.sum(-1, keepdims=True)
    good = (mass > 0) & np.isfinite(mass)
    return np.where(good, up / np.where(good, mass, 1.0), 1.0 / up.shape[-1])


def _inverse(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The symbol of each row of ``p`` at which its distribution function passes ``u``."""
    run = np.cumsum(_rows(p), axis=-1)
    return np.minimum((run <= (u * run[..., -1])[..., None]).sum(-1), p.shape[-1] - 1)


def draw(p: np.ndarray, rng: np.random.Generator) -> int:
    return int(_inverse(np.asarray(p, float)[None], np.array([rng.random()]))[0])


@dataclass
class Rounds:
    """Verdicts of a batch of rounds: accepted counts, winning drafts, tokens (beyond accepted + 1: -1), empty residuals."""

    accepted: np.ndarray
    winner: np.ndarray
    tokens: np.ndarray
    fallback: np.ndarray

    def one(self, i: int, gamma: int) -> Verdict:
        k = int(self.accepted[i])
        return Verdict(self.tokens[i, : k + 1].tolist(), k, k < gamma, bool(self.fallback[i]), int(self.winner[i]), [j < k for j in range(gamma)])


def greedy_rounds(drafts: np.ndarray, p: np.ndarray) -> Rounds:
    """Drafts (rounds, B, gamma), targets (rounds, B, gamma + 1, V): how far does each draft follow its own rows' argmax?

    A draft that agrees up to a place has the target's own rows up to there, so the longest agreement (the first of those)
    is the walk down the tree of all drafts, and the next token is the argmax of its row there.
    """
    best = p.argmax(-1)
    gamma = drafts.shape[2]
    agreed = np.logical_and.accumulate(drafts == best[:, :, :gamma], axis=2).sum(2)
    winner = agreed.argmax(1)
    r = np.arange(len(drafts))
    k = agreed[r, winner]
    return Rounds(k, winner, np.where(np.arange(gamma + 1) <= k[:, None], best[r, winner], -1), np.zeros(len(drafts), bool))


def sampled_rounds(drafts: np.ndarray, q: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> Rounds:
    """Rejection sampling for a batch of rounds, shapes as above with draft rows q (rounds, B, gamma, V).

    Place by place over all rounds at once: the drafts that agree with what was accepted are offered in turn against the
    target's row, each rejection leaving max(0, rest - q) of it; the token after the last accepted one comes from what is left
    of the row there.  Every token then follows the target's law.  An empty residual ends a round with the target's row.
    """
    count, many, gamma = drafts.shape
    r, p, q = np.arange(count), _rows(p), _rows(q)
    tries, last = rng.random((count, gamma, many)), rng.random(count)
    agree, going = np.ones((count, many), bool), np.ones(count, bool)
    tokens, accepted, fell = np.full((count, gamma + 1), -1), np.zeros(count, np.int64), np.zeros(count, bool)
    rest = p[:, 0, 0].copy()
    for i in range(gamma):
        lead = agree.argmax(1)
        own = q[r, lead, i]
        rest[going] = p[r, lead, i][going]
        taken, open_ = np.full(count, -1), going.copy()
        for b in range(many):
            x = drafts[:, b, i]
            ask = open_ & agree[:, b]
            pass_ = ask & (tries[:, i, b] * own[r, x] < rest[r, x])
            taken[pass_] = x[pass_]
            over = np.clip(rest - own, 0.0, None)
            mass = over.sum(1)
            fail = ask & ~pass_
            empty = fail & ~(mass > 0)
            shrunk = fail & (mass > 0)
            rest[shrunk] = over[shrunk] / mass[shrunk, None]
            rest[empty] = p[r, lead, i][empty]
            fell |= empty
            open_ &= ~pass_ & ~empty
        hit = taken >= 0
        tokens[hit, i] = taken[hit]
        accepted += hit
        agree[hit] &= drafts[hit, :, i] == taken[hit, None]
        going &= hit
    lead = agree.argmax(1)
    rest[going] = p[r, lead, gamma][going]
    tokens[r, accepted] = _inverse(rest, last)
    return Rounds(accepted, lead, tokens, fell)


def verify_greedy(drafts: np.ndarray, p: np.ndarray) -> Verdict:
    """One round: drafts (B, gamma) or (gamma), targets (B, gamma + 1, V) or without B."""
    drafts, p = np.atleast_2d(drafts), p if p.ndim == 3 else p[None]
    return greedy_rounds(drafts[None], p[None]).one(0, drafts.shape[1])


def verify_sample(drafts: np.ndarray, q: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> Verdict:
    """One round of ``sampled_rounds``."""
    drafts = np.atleast_2d(drafts)
    q, p = (q, p) if p.ndim == 3 else (q[None], p[None])
    return sampled_rounds(drafts[None], q[None], p[None], rng).one(0, drafts.shape[1])


def native(model: NextToken, prompt: list[int], n: int, rng: np.random.Generator | None) -> list[int]:
    """n tokens one by one; greedy without a generator."""
    seq = list(prompt)
    for _ in range(n):
        p = model.probs(np.array(seq, np.int64))
        seq.append(int(p.argmax()) if rng is None else draw(p, rng))
    return seq[len(prompt) :]


def speculative(target: NextToken, draft: NextToken, prompt: list[int], n: int, gamma: int, rng: np.random.Generator | None) -> tuple[list[int], list[int]]:
    """(n tokens, accepted count of each round): propose gamma, score gamma + 1 prefixes, verify, go on."""
    if gamma < 1:
        raise ValueError("gamma must be at least 1")
    seq, ks = list(prompt), []
    while len(seq) < len(prompt) + n:
        trial, q = list(seq), []
        for _ in range(gamma):
            q.append(draft.probs(np.array(trial, np.int64)))
            trial.append(int(q[-1].argmax()) if rng is None else draw(q[-1], rng))
        p = np.stack([target.probs(np.array(trial[: len(seq) + i], np.int64)) for i in range(gamma + 1)])
        new = np.array(trial[len(seq) :])
        v = verify_greedy(new, p) if rng is None else verify_sample(new, np.stack(q), p, rng)
        seq += v.tokens
        ks.append(v.accepted)
    return seq[len(prompt) : len(prompt) + n], ks


def keyed_rng(key: str, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(key.encode())])


def decode(prompts: DataFrame, build: Callable[[], tuple[NextToken, NextToken]], n: int, gamma: int, seed: int | None = None) -> DataFrame:
    """(name, tokens, ks) of prompts (name, seq over ACGTN); greedy without a seed. ``build`` makes the models in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, draft = build()
        for b in batches:
            rows = []
            for name, seq in zip(b["name"], b["seq"]):
                rng = None if seed is None else keyed_rng(name, seed)
                toks, ks = speculative(target, draft, [max(SYMBOLS.find(c), 0) if c in SYMBOLS else 4 for c in seq], n, gamma, rng)
                rows.append((name, "".join(SYMBOLS[t] for t in toks), ks))
            yield pd.DataFrame(rows, columns=["name", "tokens", "ks"])

    return prompts.select("name", "seq").mapInPandas(run, "name string, tokens string, ks array<int>")


def markov_rows(table: DataFrame, limit: int = 100_000) -> dict[str, np.ndarray]:
    """A model's rows from (ctx, nxt, prob); refuses tables that are too large to ship."""
    got = table.groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("nxt", "prob"))).alias("m")).limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} contexts")
    return {r["ctx"]: np.array([r["m"].get(s, 0.0) for s in SYMBOLS]) for r in got}


def greedy_walk(start: DataFrame, best: DataFrame, k: int, n: int) -> DataFrame:
    """(name, tokens): n greedy steps of a Markov table (ctx, best) for all prompts at once, a join a step."""
    rows = start.select("name", F.lpad(F.right("seq", F.lit(k)), k, "N").alias("ctx"), F.lit("").alias("tokens"))
    for _ in range(n):
        step = rows.join(best, "ctx", "left").withColumn("b", F.coalesce("best", F.lit("A")))
        rows = step.select("name", F.concat(F.right("ctx", F.lit(k - 1)), "b").alias("ctx"), F.concat("tokens", "b").alias("tokens"))
    return rows.select("name", "tokens")
