"""The training step of the language model: its sums against plain loops, and its cost against the number of groups."""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow as pa

from parcelwise.llm import lm


def shape_of(types: int) -> dict:
    """A net whose words are all in hashed slots."""
    rng = np.random.default_rng(3)
    shape = lm.layout(types)
    shape |= {"short": 0, "known": np.zeros(0, np.uint64), "rank": np.zeros(0, np.int64)}
    shape = lm.shares(shape, np.zeros(0, np.int64), rng.integers(1, 50, shape["own"] + shape["hashed"]), 3)
    return shape | {"filled": (shape["slots"].reshape(shape["groups"], shape["wide"]) > 0).sum(1)}


def lines_of(shape: dict, text: str) -> int:
    """Lines of this module that training on one text goes through."""
    count = 0

    def trace(frame, event, arg):
        nonlocal count
        if frame.f_code.co_filename != lm.__file__:
            return None
        count += event == "line"
        return trace

    old = sys.gettrace()
    sys.settrace(trace)
    try:
        assert len(list(lm.trainer(shape)([pa.RecordBatch.from_pydict({"text": [text]})]))) == 1
    finally:
        sys.settrace(old)
    return count


def test_a_step_is_not_a_loop_over_groups():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(1500))
    few, many = shape_of(50), shape_of(1_000_000)
    assert few["groups"] < 15 and many["groups"] > 150
    assert lines_of(many, text) < lines_of(few, text) + many["groups"]


def test_slot_step_against_plain_loops():
    rng = np.random.default_rng(5)
    wide, groups = 6, 9
    slot = rng.normal(size=(wide * groups, lm.SIZE + 1)).astype(np.float32)
    at = np.sort(np.concatenate([rng.integers(0, wide * groups, 70), np.full(30, 13)]))  # group 2 takes several blocks
    at = at[at // wide != 4]  # and one group has no token
    q = np.column_stack([rng.normal(size=(len(at), lm.SIZE)), np.ones(len(at))]).astype(np.float32)
    log_slot = rng.normal(size=len(slot)).astype(np.float32)
    noise = np.sort(rng.integers(0, wide, (groups, lm.SLOT_NOISE)), 1) + np.arange(groups)[:, None] * wide
    dq, rows, sums = lm.slot_step(slot, q, at, wide, lambda g: noise[g], log_slot)
    want_q, want = np.zeros(q.shape), np.zeros(slot.shape)
    for i, a in enumerate(at):
        for s, true in [(a, 1), *((s, 0) for s in noise[a // wide])]:
            d = 1 / (1 + np.exp(-(q[i].astype(float) @ slot[s] - log_slot[s] - np.log(lm.SLOT_NOISE)))) - true
            want_q[i] += d * slot[s]
            want[s] += d * q[i]
    got = np.zeros(slot.shape)
    got[rows] = sums
    assert len(set(rows.tolist())) == len(rows)
    assert np.allclose(dq[:, : lm.SIZE], want_q[:, : lm.SIZE], atol=1e-3) and np.allclose(got, want, atol=1e-3)


def test_rows_of_adds_up_and_put_rows_writes():
    rng = np.random.default_rng(6)
    for index in (rng.integers(0, 40, 300), np.arange(20)[::-1], np.full(5, 7)):
        parts = rng.normal(size=(len(index), 5)).astype(np.float32)
        rows, sums = lm.rows_of(index, parts, 40)
        want = np.zeros((40, 5))
        np.add.at(want, index, parts)
        assert rows.tolist() == sorted(set(index.tolist())) and np.allclose(sums, want[rows], atol=1e-4)
        table = np.zeros((40, 5), np.float32)
        lm.put_rows(table, rows, sums)
        assert np.allclose(table, want, atol=1e-4)


def test_found_is_a_binary_search():
    rng = np.random.default_rng(7)
    for n in (1, 2, 300):
        values = np.sort(rng.integers(0, 2**64, n, np.uint64))
        keys = np.concatenate([values, rng.integers(0, 2**64, 500, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert (lm.found(values, np.zeros(len(keys), np.int64), keys, np.less) == np.searchsorted(values, keys)).all()
        assert (lm.found(values, np.zeros(len(keys), np.int64), keys, np.less_equal) == np.searchsorted(values, keys, side="right")).all()
        shape = {"short": 0, "own": n, "hashed": 50, "known": values, "rank": np.arange(n)}
        own = np.isin(keys, values)
        assert (lm.slot_of(shape, keys)[own] == np.searchsorted(values, keys[own])).all() and (lm.slot_of(shape, keys)[~own] >= n).all()


def test_draws_follow_the_shares():
    shape = shape_of(50)
    draw, groups = lm.drawing(shape, np.random.default_rng(8)), np.arange(shape["groups"])
    drawn = np.concatenate([draw(groups) for _ in range(3000)], axis=1)
    assert (drawn // shape["wide"] == groups[:, None]).all() and (np.diff(draw(groups)) >= 0).all()
    share = np.bincount(drawn.ravel(), minlength=len(shape["slots"])) / drawn.shape[1]
    assert np.abs(share - shape["slots"]).max() < 0.01
