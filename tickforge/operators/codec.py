"""Fixed-layout binary messages, web-socket frames and JSON text."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Little-endian layouts and their headers (length, template, schema, version).
QUOTE, QUOTE_HEADER = struct.Struct("<4H4Q2HIQqQqQ2H"), (84, 101, 1, 1)
TRADE, TRADE_HEADER = struct.Struct("<4H4Q2HIQQBqQQHBBH"), (87, 100, 1, 1)
#: Bytes of a binary message of each stream (1: quotes, 3: trades), and the most of a JSON text.
SIZES, MOST_JSON = {1: QUOTE.size, 3: TRADE.size}, 512
QUOTE_FIELDS = ["t0_ns", "t1_ns", "t2_ns", "t3_ns", "venue", "chain", "market_id", "sequence", "bid_px8", "bid_qty8", "ask_px8", "ask_qty8", "spread_bps", "flags"]


TRADE_FIELDS = [*QUOTE_FIELDS[:8], "trade_id", "side", "price_px8", "size_qty8", "quote_qty8", "fee", "venue_type", "is_liquidation", "tail"]


def _layout(fields: list[str], packed: struct.Struct) -> np.dtype:
    kinds = {"H": "<u2", "Q": "<u8", "q": "<i8", "I": "<u4", "B": "u1"}
    letters = [c for n, c in re.findall(r"(\d*)([HQqIB])", packed.format) for _ in range(int(n or 1))]
    return np.dtype([(f, kinds[c]) for f, c in zip(["length", "template", "schema", "version", *fields], letters, strict=True)])


_QUOTES, _TRADES = _layout(QUOTE_FIELDS, QUOTE), _layout(TRADE_FIELDS, TRADE)


def _packed(b: pa.RecordBatch, layout: np.dtype, header: tuple, fields: list[str]) -> pa.Array:
    """Messages of the rows of a batch, all at once; null where a field is null."""
    out, known = np.zeros(b.num_rows, layout), np.ones(b.num_rows, bool)
    for name, value in zip(("length", "template", "schema", "version"), header, strict=True):
        out[name] = value
    for f in fields:
        c = b.column(b.schema.get_field_index(f))
        known &= c.is_valid().to_numpy(zero_copy_only=False)
        c = c.cast(pa.int64()) if pa.types.is_boolean(c.type) else c
        out[f] = c.fill_null(0).to_numpy(zero_copy_only=False).astype(layout[f])
    if "quote_qty8" in layout.names:
        price, size = out["price_px8"].astype(np.int64), out["size_qty8"].astype(np.int64)
        high, low = np.divmod(np.maximum(price, 0), 10**8)  # price * size / 10^8 in 64 bits: by parts of the price
        small = (size < 1 << 36) & (high < 1 << 26)
        exact = high * size + low * np.where(small, size, 0) // 10**8
        slow = np.flatnonzero(~small & (price > 0))
        exact[slow] = [int(price[i]) * int(size[i]) // 10**8 & MASK63 for i in slow]
        out["quote_qty8"], out["venue_type"] = np.maximum(exact, 0), 1
    raw = pa.array([out.tobytes()], pa.binary()).buffers()[2]
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(layout.itemsize), b.num_rows, [None, raw])
    return pc.if_else(pa.array(known), fixed.cast(pa.binary()), pa.scalar(None, pa.binary()))


MASK63 = (1 << 63) - 1


def _unpacked(column: pa.Array, layout: np.dtype, header: tuple, fields: list[str]) -> dict[str, pa.Array]:
    """`fields` and `error` (too small, bad schema, bad template) of messages; neither version nor block length is checked; longer messages are cut."""
    n, size = len(column), layout.itemsize
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    whole = lengths >= size
    cut = pc.binary_slice(column.filter(pa.array(whole)), 0, size)
    rows = np.zeros(n, layout)
    rows[whole] = np.frombuffer(b"".join(cut.to_pylist()), layout)
    error = np.where(~whole, "too small", np.where(rows["schema"] != header[2], "bad schema", np.where(rows["template"] != header[1], "bad template", "")))
    bad = error != ""
    made = {f: pa.array(rows[f].astype(bool) if f == "is_liquidation" else rows[f].astype(np.int64), mask=bad) for f in fields}
    return made | {"error": pa.array(error.astype(object), pa.string(), mask=~bad)}


def encode(df: DataFrame, stream: int, out: str = "sbe") -> DataFrame:
    """`df` with a binary message of each quote (stream 1) or trade (3), packed a batch at a time."""
    layout, header, fields = (_QUOTES, QUOTE_HEADER, QUOTE_FIELDS) if stream == 1 else (_TRADES, TRADE_HEADER, [*TRADE_FIELDS[:12], "is_liquidation"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = {f: c for f, c in zip(b.schema.names, b.columns, strict=True) if f != out}
            yield pa.RecordBatch.from_pydict(kept | {out: _packed(b, layout, header, fields)})

    return df.mapInArrow(run, df.drop(out).withColumn(out, F.lit(None).cast("binary")).schema)


def decode(df: DataFrame, stream: int, column: str = "sbe") -> DataFrame:
    """`df` with a struct `message` of the fields of its binary messages, and `error`."""
    layout, header, fields = (_QUOTES, QUOTE_HEADER, QUOTE_FIELDS) if stream == 1 else (_TRADES, TRADE_HEADER, [*TRADE_FIELDS[:12], "is_liquidation"])
    kinds = ", ".join(f"{f}: {'boolean' if f == 'is_liquidation' else 'bigint'}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = {f: c for f, c in zip(b.schema.names, b.columns, strict=True) if f not in ("message", "error")}
            got = _unpacked(b.column(b.schema.get_field_index(column)), layout, header, fields)
            error = got.pop("error")
            yield pa.RecordBatch.from_pydict(kept | {"message": pa.StructArray.from_arrays(list(got.values()), names=list(got)), "error": error})

    return df.mapInArrow(run, df.drop("message", "error").withColumn("message", F.lit(None).cast(f"struct<{kinds}>")).withColumn("error", F.lit(None).cast("string")).schema)


def unmasked(payload: bytes, mask: bytes) -> bytes:
    n = len(payload)
    whole = (mask * (n // 4 + 1))[:n]
    return (int.from_bytes(payload, "big") ^ int.from_bytes(whole, "big")).to_bytes(n, "big")


def frame(opcode: int, payload: bytes) -> bytes:
    n = len(payload)
    head = bytes([n]) if n < 126 else b"\x7e" + n.to_bytes(2, "big") if n < 1 << 16 else b"\x7f" + n.to_bytes(8, "big")
    return bytes([0x80 | opcode]) + head + payload


def frame_header(data: bytes) -> dict:
    """fin, opcode, length, mask and header size of a frame, or `error`."""
    if len(data) < 2:
        return {"error": "incomplete"}
    n, at = data[1] & 127, 2
    if n >= 126:
        at += 2 if n == 126 else 8
        n = int.from_bytes(data[2:at], "big")
    masked = bool(data[1] & 128)
    if len(data) < at + 4 * masked:
        return {"error": "incomplete"}
    if data[0] & 15 not in (0, 1, 2, 8, 9, 10):
        return {"error": "invalid opcode"}
    return {"fin": bool(data[0] & 128), "opcode": data[0] & 15, "length": n, "mask": data[at : at + 4] if masked else None, "size": at + 4 * masked, "error": None}


def framed(opcode: int, payload: Column) -> Column:
    """A binary column in unmasked frames of one part."""
    n, head = F.length(payload), f"{0x80 | opcode:02X}"
    size = F.when(n < 126, F.lpad(F.hex(n), 2, "0")).when(n < 1 << 16, F.concat(F.lit("7E"), F.lpad(F.hex(n), 4, "0"))).otherwise(F.concat(F.lit("7F"), F.lpad(F.hex(n), 16, "0")))
    return F.concat(F.unhex(F.concat(F.lit(head), size)), payload)


def opened(df: DataFrame, column: str = "data") -> DataFrame:
    """`df` with opcode, body (unmasked) and error of the frames in a binary column; nothing behind a frame is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            opcodes, bodies, errors = [], [], []
            for data in b.column(b.schema.get_field_index(column)).to_pylist():
                h = frame_header(data or b"")
                if not h["error"] and len(data) < h["size"] + h["length"]:
                    h = {"error": "incomplete"}
                body = None if h["error"] else data[h["size"] : h["size"] + h["length"]]
                opcodes.append(h.get("opcode"))
                bodies.append(unmasked(body, h["mask"]) if body is not None and h["mask"] else body)
                errors.append(h["error"])
            kept = {f: c for f, c in zip(b.schema.names, b.columns, strict=True) if f not in ("opcode", "body", "error")}
            yield pa.RecordBatch.from_pydict(kept | {"opcode": pa.array(opcodes, pa.int32()), "body": pa.array(bodies, pa.binary()), "error": pa.array(errors, pa.string())})

    made = df.drop("opcode", "body", "error").withColumns({"opcode": F.lit(None).cast("int"), "body": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")})
    return df.mapInArrow(run, made.schema)


def _text(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value.cast("string"))


def _quoted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))


def _telemetry() -> Column:
    return F.concat(F.lit('"telemetry":{'), F.concat_ws(",", *(_text(t, F.col(f"{t}_ns")) for t in ("t0", "t1", "t2", "t3"))), F.lit("}"))


def quote_json() -> Column:
    plain = [_text(n, F.col(n)) for n in ("market_id", "venue", "chain", "sequence")]
    sides = [_quoted(n, S.text8(F.col(c))) for n, c in (("bid_px", "bid_px8"), ("bid_qty", "bid_qty8"), ("ask_px", "ask_px8"), ("ask_qty", "ask_qty8"))]
    return F.concat(F.lit('{"type":"bbo",'), F.concat_ws(",", *plain, *sides, _text("spread_bps", F.col("spread_bps")), _text("flags", F.col("flags")), _telemetry()), F.lit("}"))


def trade_json() -> Column:
    plain = [_text(n, F.col(n)) for n in ("market_id", "venue", "chain", "sequence", "trade_id")]
    rest = [_quoted("price", S.text8(F.col("price_px8"))), _quoted("size", S.text8(F.col("size_qty8"))), _text("side", F.col("side")), _text("is_liquidation", F.col("is_liquidation")), _telemetry()]
    return F.concat(F.lit('{"type":"trade",'), F.concat_ws(",", *plain, *rest), F.lit("}"))
