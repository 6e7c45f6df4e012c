"""Restore placeholders in streamed answers, where a placeholder may be cut by chunk borders.

What may still become a placeholder is held back: an opening ``<`` near the end of the text seen so
far. It waits in the state of its call until more text, an end mark or a timeout comes.
"""

from __future__ import annotations

import json
import pickle
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import MAPPING_TTL_SECONDS, MAX_PLACEHOLDER
from ..functions.crypto import open_sealed
from ..functions.spans import replace_known
from ..functions.text import let

_HELD = re.compile(r"<[^<>]{0,%d}\Z" % (MAX_PLACEHOLDER - 2))
_PLACEHOLDER = re.compile(r"<[A-Z]+_\d+>")

CHUNK_OUT = "call_id string, seq bigint, part int, text string"
_WAITING = "pending string, seq bigint, mapping string"
#: How long held text waits for its continuation.
WAIT_MS = 600_000
#: States that calls share by a hash of their id: a task answers for all calls of one at once.
BUCKETS = 1024


class _Known:
    """A mapping that is read from its JSON text only when a placeholder asks for it."""

    def __init__(self, written: str) -> None:
        self.written = written
        self.read = None

    def get(self, name: str, default: str) -> str:
        if self.read is None:
            self.read = json.loads(self.written)
        return self.read.get(name, default)


def _restored(text: str, mapping) -> str:
    return _PLACEHOLDER.sub(lambda m: mapping.get(m[0], m[0]), text) if "<" in text else text


def _split(pending: str, text: str) -> tuple[str, str]:
    """What may be sent now, and what has to wait."""
    seen = pending + text
    wait = _HELD.search(seen) if "<" in seen else None
    return (seen[: wait.start()], seen[wait.start() :]) if wait else (seen, "")


def _next(pending: str, text: str, mapping) -> tuple[str, str]:
    sent, pending = _split(pending, text)
    return _restored(sent, mapping), pending


def _frame(frame: str, pending: str, mapping: dict[str, str]) -> tuple[str, str]:
    """Restore the text deltas of one server-sent-event frame; other lines stay as they are."""
    lines = frame.splitlines(keepends=True)
    for n, line in enumerate(lines):
        body = line.removesuffix("\n").removesuffix("\r") if line.endswith("\n") else line
        try:
            event = json.loads(body[6:]) if body.startswith("data: ") else None
        except ValueError:
            continue
        delta = event.get("delta") if isinstance(event, dict) else None
        if isinstance(delta, dict) and isinstance(delta.get("text"), str):
            delta["text"], pending = _next(pending, delta["text"], mapping)
            written = json.dumps(event, ensure_ascii=False, separators=(",", ":"))
            lines[n] = "data: " + written + line[len(body):]
    return "".join(lines), pending


def _chunk(text: str, pending: str, mapping) -> tuple[str, str]:
    return _next(pending, text, mapping)


def _walked(step: Callable, chunks: Iterable[tuple], pending: str, mapping) -> tuple[list, str, object]:
    """What is sent of each (seq, text, last, mapping) of a call in order; the text and mapping that wait."""
    out = []
    for seq, text, last, known in chunks:
        # Held text keeps the mapping it came with where the next chunk has none.
        mapping = known if known is not None else mapping if pending else {}
        if text is None:
            # A chunk without text lets go of whatever waits.
            sent, pending = (_restored(pending, mapping) or None), ""
        else:
            sent, pending = step(text, pending, mapping)
        if last and pending and step is _chunk:
            sent, pending = (sent or "") + _restored(pending, mapping), ""
        out.append((seq, sent))
    return out, pending, mapping


def _stateful(step: Callable, timeout_ms: int | None):
    """A state for each call."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, at, kept = state.get if state.exists else ("", 0, "{}")
        if state.hasTimedOut:
            state.remove()
            tail = _restored(pending, json.loads(kept))
            yield pd.DataFrame({"call_id": [key[0]], "seq": [at], "part": [1], "text": [tail]})
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        known = [None if m is None else dict(m) for m in rows["mapping"]]
        out, pending, mapping = _walked(step, zip(rows["seq"], rows["text"], rows["last"], known), pending, json.loads(kept))
        if pending:
            state.update((pending, int(rows["seq"].iloc[-1]), json.dumps(mapping)))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], seq, 0, sent) for seq, sent in out], columns=["call_id", "seq", "part", "text"])

    return handle


def _whole(numbers: pd.Series) -> list:
    return [None if n != n else int(n) for n in numbers.tolist()] if numbers.isna().any() else numbers.tolist()


def _in_order(chunk: tuple) -> tuple:
    return chunk[0] is None, chunk[0] or 0


def _shared(step: Callable, timeout_ms: int | None):
    """A state for each bucket of calls: what waits, as [call, text, seq, mapping, due] of each."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {w[0]: w[1:] for w in json.loads(state.get[0])} if state.exists else {}
        calls, read = {}, {}
        for rows in () if state.hasTimedOut else batches:
            columns = (rows["call_id"], _whole(rows["seq"]), rows["text"], rows["last"], rows["mapping"])
            for call, seq, text, last, written in zip(*columns, strict=True):
                known = None if written is None else read.get(written) or read.setdefault(written, _Known(written))
                calls.setdefault(call, []).append((seq, text, last, known))
        now = state.getCurrentProcessingTimeMs() if timeout_ms else 0
        out = [[], [], [], []]

        def send(*row) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        for call, chunks in calls.items():
            pending, _, kept, _ = waiting.pop(call, ("", 0, "{}", 0))
            chunks.sort(key=_in_order)
            sent, pending, mapping = _walked(step, chunks, pending, _Known(kept))
            for seq, text in sent:
                send(call, seq, 0, text)
            if pending:
                kept = mapping.written if isinstance(mapping, _Known) else "{}"
                waiting[call] = [pending, chunks[-1][0], kept, now + (timeout_ms or 0)]
        for call in [c for c, w in waiting.items() if timeout_ms and w[3] <= now]:
            pending, at, kept, _ = waiting.pop(call)
            send(call, at, 1, _restored(pending, _Known(kept)))
        if waiting:
            state.update((json.dumps([[c, *w] for c, w in waiting.items()]),))
            if timeout_ms:
                state.setTimeoutDuration(max(1, min(w[3] for w in waiting.values()) - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(dict(zip(("call_id", "seq", "part", "text"), out, strict=True)))

    return handle


def _bucket(call: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(call), F.lit(buckets)).cast("int").alias("bucket")


def _restore(chunks: DataFrame, step: Callable, timeout_ms: int | None, buckets: int | None) -> DataFrame:
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    if buckets is None:
        return chunks.groupBy("call_id").applyInPandasWithState(
            _stateful(step, timeout_ms), CHUNK_OUT, _WAITING, "append", timeout
        )
    rows = chunks.select("call_id", "seq", "text", "last", F.to_json("mapping").alias("mapping"), _bucket(F.col("call_id"), buckets))
    return rows.groupBy("bucket").applyInPandasWithState(_shared(step, timeout_ms), CHUNK_OUT, "waiting string", "append", timeout)


def restore_chunks(chunks: DataFrame, timeout_ms: int | None = WAIT_MS, buckets: int | None = BUCKETS) -> DataFrame:
    """Restore a stream of chunks: call_id, seq, text, last, mapping.

    Chunks of a call may come in any order within a micro-batch, and in order across them. Held text
    whose continuation does not come within ``timeout_ms`` is sent as part 1 of the chunk it ended,
    and its state goes; sort by seq and part. Pass None for a run that ends once its input is read.

    Calls share ``buckets`` states, and a task holds the chunks that a micro-batch brings to one of them.
    None keeps a state for each call, which costs milliseconds a call and micro-batch.
    """
    return _restore(chunks, _chunk, timeout_ms, buckets)


def restore_frames(frames: DataFrame, timeout_ms: int | None = WAIT_MS, buckets: int | None = BUCKETS) -> DataFrame:
    """The same for captured event frames, with the frame as ``text``."""
    return _restore(frames, _frame, timeout_ms, buckets)


class _Call:
    """What a joined stream keeps of a call, times in microseconds: chunks the watermark has not passed,
    as (seq, text, last, ts); mappings by the time they were put; held text with its place, mapping and due time."""

    __slots__ = ("chunks", "puts", "held")

    def __init__(self, chunks=(), puts=(), held=None) -> None:
        self.chunks, self.puts, self.held = dict.fromkeys(chunks), dict(puts), held

    def packed(self) -> tuple:
        return list(self.chunks), list(self.puts.items()), self.held

    def due(self, ttl: int) -> int | None:
        """When the watermark must look at this call again."""
        times = [c[3] for c in self.chunks] + [t + ttl for t in self.puts] + ([self.held[3]] if self.held else [])
        return min(times, default=None)

    def passed(self, mark: int, ttl: int, wait: int) -> list[tuple]:
        """(seq, part, text, sealed mapping) of what the watermark has passed."""
        ready = sorted((c for c in self.chunks if c[3] <= mark), key=_in_order)
        out = []
        if ready:
            times = sorted(self.puts)
            pending, _, kept, _ = self.held or ("", 0, None, 0)
            for seq, text, last, ts in ready:
                n = bisect_right(times, ts)
                blob = self.puts[times[n - 1]] if n and times[n - 1] >= ts - ttl else None
                kept = blob if blob is not None else kept if pending else None
                sent, pending = (pending, "") if text is None else _split(pending, text)
                if last:
                    sent, pending = sent + pending, ""
                out.append((seq, 0, sent, kept))
                del self.chunks[seq, text, last, ts]
            self.held = (pending, seq, kept, max(mark, *(c[3] for c in ready)) + wait) if pending else None
        elif self.held and self.held[3] <= mark:
            out.append((self.held[1], 1, self.held[0], self.held[2]))
            self.held = None
        # Later chunks come after the watermark: of the mappings before it the last one alone can count.
        last_put = max((t for t in self.puts if t <= mark), default=None)
        self.puts = {t: b for t, b in self.puts.items() if t > mark or (t == last_put and t > mark - ttl)}
        return out


_JOINED_OUT = "call_id string, seq bigint, part int, text string, blob binary"


def _joined(wait: int, ttl: int):
    """A state for each bucket of calls: all its calls, packed."""

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls = {c: _Call(*packed) for c, packed in pickle.loads(state.get[0]).items()} if state.exists else {}
        for rows in () if state.hasTimedOut else batches:
            columns = (rows["call_id"], rows["us"], _whole(rows["seq"]), rows["text"], rows["last"], rows["put"], rows["blob"])
            for call, us, seq, text, last, put, blob in zip(*(list(c) for c in columns), strict=True):
                of = calls.get(call) or calls.setdefault(call, _Call())
                if put:
                    of.puts[us] = None if blob is None else bytes(blob)
                else:
                    of.chunks[seq, text, last, us] = None
        mark, out, due = state.getCurrentWatermarkMs() * 1000, [[], [], [], [], []], []
        for call, of in list(calls.items()):
            for seq, part, text, blob in of.passed(mark, ttl, wait):
                opened = blob if "<" in text and _PLACEHOLDER.search(text) else None
                for column, value in zip(out, (call, seq, part, text, opened), strict=True):
                    column.append(value)
            at = of.due(ttl)
            if at is None:
                del calls[call]
            else:
                due.append(at)
        if calls:
            state.update((pickle.dumps({c: of.packed() for c, of in calls.items()}, protocol=5),))
            state.setTimeoutTimestamp(max(min(due) // 1000, mark // 1000 + 1, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(dict(zip(("call_id", "seq", "part", "text", "blob"), out, strict=True)))

    return handle


def restore_joined(
    chunks: DataFrame,
    mappings: DataFrame,
    key_hex: str,
    prefix: str = "pii-map:",
    late: str = "5 minutes",
    ttl_seconds: int = MAPPING_TTL_SECONDS,
    timeout_ms: int = WAIT_MS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Restore a stream of chunks (call_id, seq, text, last, ts) with mappings that come as another stream
    (store_key, put_ts, blob, sealed by ``operators.mapping.put``).

    A chunk sees the last mapping put no later than it and no more than ``ttl_seconds`` before it; what
    is kept is bounded by that on both sides. Either stream may be ``late``: a chunk is sent once
    the watermark has passed it, so that no mapping put before it can still come. Chunks without a
    live mapping, or with one sealed for another key, keep their placeholders. Times of a call must not fall
    along ``seq``. Rows without time are dropped, and equal chunks count once. Held text waits
    ``timeout_ms`` of event time. Mappings stay sealed in the state, and ``buckets`` states are shared as
    in ``restore_chunks``. Start the stream inside ``state.rocksdb``.
    """
    asked = chunks.select("call_id", "seq", "text", "last", "ts").withWatermark("ts", late).where("ts IS NOT NULL")
    stored = mappings.select("store_key", F.col("put_ts").alias("ts"), "blob").withWatermark("ts", late)
    stored = stored.where("ts IS NOT NULL").where(F.startswith("store_key", F.lit(prefix)))

    def opened(blob: Column, name: Column) -> Column:
        return F.from_json(open_sealed(blob, key_hex, name), "map<string,string>")

    def sides(call, seq, text, last, put, blob) -> list[Column]:
        columns = {"call_id": call, "seq": seq, "text": text, "last": last, "put": put, "blob": blob}
        return [F.col("ts"), F.unix_micros("ts").alias("us"), *[c.alias(n) for n, c in columns.items()], _bucket(call, buckets)]

    # A mapping that does not open under its own name is none, but later than those before it.
    fits = F.when(opened(F.col("blob"), F.col("store_key")).isNotNull(), F.col("blob"))
    none = F.lit(None)
    left = asked.select(*sides(*[F.col(c) for c in ("call_id", "seq", "text", "last")], F.lit(False), none.cast("binary")))
    call = F.substring("store_key", len(prefix) + 1, 2**31 - 1)
    right = stored.select(*sides(call, none.cast("bigint"), none.cast("string"), none.cast("boolean"), F.lit(True), fits))
    sent = left.union(right).groupBy("bucket").applyInPandasWithState(
        _joined(timeout_ms * 1000, ttl_seconds * 1_000_000), _JOINED_OUT, "calls binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    known = opened(F.col("blob"), F.concat(F.lit(prefix), "call_id"))
    text = let(known, lambda k: replace_known(F.col("text"), r"<[A-Z]+_\p{Nd}+>", k))
    text = F.when(F.col("blob").isNull(), F.col("text")).otherwise(text)
    return sent.select("call_id", "seq", "part", text.alias("text"))
