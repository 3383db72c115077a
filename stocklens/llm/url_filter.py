"""URL filtering with a bit-parallel wildcard automaton.

Every glob rule is a run of bits in one wide bit vector, held as 64-bit words.
For each byte of a URL the whole vector advances at once (Shift-And): a bit
moves up where the rule's next byte fits, and stays where a wildcard stands.
URLs of a batch advance together, longest first, so a long URL costs only its
own steps.

In a rule ``*`` is any run of bytes without ``/`` and ``**`` any run at all.
Rules see ``.host/path``, so ``*.org/`` fits org and all its subdomains.

Rules and globs may come from tables of thousands (``rules_of``, ``globs_of``):
they are compiled once, and sent along if they have ``MOST_RULE_BYTES`` at most,
for a byte of a rule is a bit in 256 masks (16 MB in all); more raise an error. URLs
go through in blocks whose states have ``STATE_BYTES``, however many rules there are.

Null URLs and URLs without ``://`` have empty host and path; no rule fits
them and they are allowed. Order and repetition of rows do not matter; of rules
of equal length that fit, the first by bytes wins. Null rules are none. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: rule -> verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
# The method's own rules for URLs that none of the above fits: hosts with a label that begins so.
BLOCKED = ("*.casino**", "*.cheap-pills**", "*.adult**", "*.ads-track**")
MOST_RULE_BYTES = 1 << 18
STATE_BYTES = 1 << 24


@dataclass
class Automaton:
    """Masks by byte: ``step`` bits reached by that byte, ``stay`` bits that keep on it."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    words: np.ndarray  # of each rule's last bit
    bits: np.ndarray


def compile_globs(globs: list[str]) -> Automaton:
    parsed = []
    for glob in globs:
        states, i, raw = [(None, None)], 0, glob.encode()
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                states[-1], i = (states[-1][0], "any"), i + 2
            elif raw[i : i + 1] == b"*":
                states[-1], i = (states[-1][0], states[-1][1] or "segment"), i + 1
            else:
                states.append((raw[i], None))
                i += 1
        parsed.append(states)
    width = max(1, -(-sum(map(len, parsed)) // 64))
    step, stay, start = np.zeros((256, width), np.uint64), np.zeros((256, width), np.uint64), np.zeros(width, np.uint64)
    at, ends = 0, []
    for states in parsed:
        for k, (byte, star) in enumerate(states):
            word, bit = (at + k) // 64, np.uint64(1) << np.uint64((at + k) % 64)
            if k == 0:
                start[word] |= bit
            if byte is not None:
                step[byte, word] |= bit
            if star:
                stay[:, word] |= bit
                if star != "any":
                    stay[ord("/"), word] &= ~bit
        at += len(states)
        ends.append(at - 1)
    last = np.array(ends, np.int64)
    return Automaton(step, stay, start, last // 64, np.uint64(1) << (last % 64).astype(np.uint64))


def _bounded(texts: DataFrame, column: str) -> None:
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    if size > MOST_RULE_BYTES:
        raise ValueError(f"rules of {size} bytes; at most {MOST_RULE_BYTES} are sent to every task")


def globs_of(table: DataFrame, column: str = "glob") -> tuple[str, ...]:
    """The distinct globs of a table, for ``judge``."""
    texts = table.select(F.col(column).cast("string").alias("glob")).filter("glob is not null").distinct()
    _bounded(texts, "glob")
    return tuple(sorted(r["glob"] for r in texts.collect()))


def rules_of(table: DataFrame, rule: str = "rule", verdict: str = "verdict") -> dict[str, str]:
    """Rules (host and path) with their verdicts, allow or block, from a table; where a rule has both, it blocks."""
    texts = table.select(F.col(rule).cast("string").alias("rule"), F.col(verdict).cast("string").alias("verdict")).filter("rule is not null and verdict in ('allow', 'block')")
    texts = texts.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    _bounded(texts, "rule")
    return {r["rule"]: r["verdict"] for r in texts.collect()}


def matches(auto: Automaton, urls: list[bytes]) -> Iterator[np.ndarray]:
    """Boolean matrices, URL x rule, of the URLs in turn, a block at a time."""
    block = max(1, STATE_BYTES // (8 * len(auto.start)))
    for at in range(0, len(urls), block):
        yield _matched(auto, urls[at : at + block])


def _matched(auto: Automaton, urls: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, urls), np.int64, len(urls))
    order = np.argsort(-size, kind="stable")
    size, start = size[order], (np.cumsum(size) - size)[order]
    text = np.frombuffer(b"".join(urls) or b"\0", np.uint8)
    state = np.repeat(auto.start[None, :], len(urls), axis=0)
    carry, up = np.uint64(63), np.uint64(1)
    active = len(urls)
    for at in range(int(size[0]) if len(urls) else 0):
        active = int(np.searchsorted(-size[:active], -at, "left"))  # those longer than `at`
        now = state[:active]
        byte = text[start[:active] + at]
        moved = now << up
        moved[:, 1:] |= now[:, :-1] >> carry
        state[:active] = (moved & auto.step[byte]) | (now & auto.stay[byte])
    out = np.empty((len(urls), len(auto.words)), bool)
    out[order] = (state[:, auto.words] & auto.bits) != 0
    return out


_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def judge(pages: DataFrame, *, rules: dict[str, str] | None = None, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. Of the rules that fit, the longest wins."""
    rules = RULES if rules is None else rules
    names = sorted(rules, key=lambda r: (-len(r), r.encode()))
    first = len(names)
    auto = compile_globs([f"*.{r}**" for r in names] + list(blocked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [canonical(u) for u in b.column(1).to_pylist()]
            rule, verdict = [], []
            for hit in matches(auto, [f".{h}{p}".encode() for h, p in parts]):
                fits = np.where(hit[:, :first].any(axis=1), hit[:, :first].argmax(axis=1), -1) if first else np.full(len(hit), -1)
                for k, bad in zip(fits.tolist(), hit[:, first:].any(axis=1).tolist(), strict=True):
                    rule.append(None if k < 0 else names[k])
                    verdict.append(("block" if bad else "allow") if k < 0 else rules[names[k]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), h AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), m AS (
  SELECT page_id, host, path,
         CASE WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches('.' || host, '\.(casino|cheap-pills|adult|ads-track)') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""
