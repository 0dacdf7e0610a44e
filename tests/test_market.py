from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tickforge.functions import scalars as S
from tickforge.operators import amm, codec, folds, ordered, parsers, rings, router, session, websocket
from tickforge.plans import catalogue
from tickforge.sources import simulator, transports

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, values):
    return sorted([tuple("~" if r[names.index(c)] is None else str(r[names.index(c)]) for c in sorted(names)) for r in values])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, DATA)
    theirs = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(names, theirs.fetchall())


def test_fixed_point(spark):
    got = spark.createDataFrame([("123.45",), ("0.00000001",), ("65000",), ("1.123456789",), ("-2.5",)], "x string").select(S.fixed8(F.col("x"))).collect()
    assert [r[0] for r in got] == [12345000000, 1, 6500000000000, 112345678, -250000000]


def test_iso(spark):
    texts = ["2023-01-01T00:00:00Z", "2023-01-01T00:00:01.041089Z", "2024-02-29T12:00:00Z", "not a time", "2023-13-01T00:00:00Z", "2023-01-01T00:00:00"]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(S.iso_ns(F.col("x"))).collect()
    assert [r[0] for r in got] == [1672531200000000000, 1672531201041089000, 1709208000000000000, None, None, None]


def test_simulator():
    r = simulator.Random64(42)
    assert [r.next() for _ in range(3)] == [6255019084209693600, 14430073426741505498, 14575455857230217846]
    out = list(simulator.feed(1337, 1000, 1_700_000_000_000_000_000))
    assert out[0][1:4] == ("bbo", 4, 1003) and out[0][7:12] == (14996249443, 2052580727, 15003749441, 1178386877, 5)
    assert out[2][2:5] == (102, 1002, 1000001) and out[2][7:12] == (349754951789, 9787728687, 350244951721, 9787728687, 14)
    assert sum(x[1] == "trade" for x in out) == 111


def test_simulator_bursts():
    whole, f = list(simulator.feed(1337, 300, 5)), simulator.Feed(1337)
    first = list(f.burst(120, 5))
    assert first + list(simulator.Feed(0, json.loads(json.dumps(f.state()))).burst(180, 5)) == whole
    assert first + list(f.burst(180, 5)) == whole


def test_simulator_stream(spark, tmp_path):
    """Each start takes one burst more, from where the checkpoint stands, until `events` are made."""
    spark.dataSource.register(simulator.FeedSource)
    for rows in (40, 80, 100, 100):
        stream = spark.readStream.format("tickforge_feed").options(seed=7, burst=40, events=100, base_ns=5).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ord").collect()]
        assert got == list(simulator.feed(7, rows, 5))


def test_amm():
    assert amm.v2_spot(1000 * 10**18, 2_000_000 * 10**6) == 200000000000
    assert [x[2:] for x in amm.v2_levels(1000 * 10**18, 2_000_000 * 10**6, [10, 25])] == [(200200000000, 49962600), (199800000000, 50037500), (200500000000, 124766200), (199500000000, 125234800)]
    assert amm.sqrt_spot(3543191142285914205922034323210) == 200000000000 and amm.sqrt_spot(1 << 96) == 100000000
    ticks = [(90, -5 * 10**9), (100, 10**10), (110, -5 * 10**9)]
    levels = amm.tick_levels(200000000000, 100, 5 * 10**13, ticks, 5)
    assert ("ask", 2, 200050001000, 50010) in levels and ("bid", 0, 199949999001, 49990) in levels
    assert amm.v4_fee(0x800000, None, 0, False) == 30 and amm.v4_fee(0x800000, 12, -2, True) == 10
    three = [10_000_000 * 10**18, 10_000_000 * 10**6, 10_000_000 * 10**6]
    assert amm.curve_d([10_000_000 * 10**18] * 3, 200) == 30_000_000 * 10**18
    assert amm.curve_spot(0, 1, three, [18, 6, 6], 200, 4) == 99959900
    assert amm.curve_out(0, 1, 10_000 * 10**18, three, [18, 6, 6], 200, 4) == 9995994449
    assert amm.swap_impact(1000 * 10**18, 2_000_000 * 10**6, 30, True, 100_000 * 10**6) == (47482973758155927037, 220468499999, 1023)


def test_codec():
    for n in (0, 125, 126, 65535, 65536):
        h = codec.frame_header(codec.frame(2, b"x" * n))
        assert (h["length"], h["opcode"], h["mask"]) == (n, 2, None)


def test_token_bucket(spark):
    rows_ = [(1, 1000, i) for i in range(11)] + [(1, 1100, 20 + i) for i in range(11)]
    got = router.rate_limited(spark.createDataFrame(rows_, "client_id long, now_ms long, ord long"), 100, 10).orderBy("ord").collect()
    assert [r.delivered for r in got] == [True] * 10 + [False] + [True] * 10 + [False]


def test_sequence_tracker(spark):
    rows_ = [(1, 1, "snapshot", 0, 100), (1, 2, "delta", 101, 105), (1, 3, "delta", 108, 110)]
    got = folds.sequence_tracker(spark.createDataFrame(rows_, "market_id long, ord long, kind string, first_seq long, final_seq long")).orderBy("ord").collect()
    assert [(r.accepted, r.status, r.expected) for r in got] == [(True, "in_sync", None), (True, "in_sync", 101), (False, "gap", 106)]


def test_ladder_equals_window_without_deletions(spark):
    rows_ = [(1, i, 10_000_000_000, "bid", 10_000_000_000 + (i * 7919 % 500) * 100_000, 5) for i in range(300)]
    df = spark.createDataFrame(rows_, "book_id long, ord long, base_px8 long, side string, price_px8 long, quantity long")
    got = [r.bid_px8 for r in folds.ladder(df).orderBy("ord").collect()]
    best, want = 0, []
    for r in rows_:
        best = max(best, r[4])
        want.append(best)
    assert got == want


def test_malformed(spark):
    texts = ["", "not json", "{}", '{"type":"ticker"}']
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    assert not any(r.ok for r in parsers.coinbase_bbo(df).collect())


def test_streaming_equals_batch(spark, tmp_path):
    from tickforge.streaming import dispatch

    from tickforge.sources import adapters as A

    quotes = A.bbo(spark, DATA)
    quotes.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(quotes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    dispatch.run(stream, A.subscriptions(spark, DATA), A.clients(spark, DATA), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = catalogue.QUERIES["dispatch_metrics_unlimited"](spark, DATA)
    assert rows(want.columns, [tuple(r) for r in got.select(want.columns).collect()]) == rows(want.columns, [tuple(r) for r in want.collect()])
    lag = dispatch.sequence_regressions(spark.readStream.schema(quotes.schema).parquet(str(tmp_path / "in")).withColumn("sequence", F.col("ord")))
    q = lag.writeStream.format("memory").queryName("regressions").outputMode("update").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("regressions").count() == 0


def test_text_that_is_no_number(spark):
    texts = ["abc", "1e5", "99999999999999999999", "1.2.3", "", "-", "--5", "1.123456789", "92233720368.54775807", "92233720368.54775808", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(S.fixed8(F.col("x"))).collect()]
    assert got == [0, 1_500_000_000, None, 1_230_000_000, 0, 0, -500_000_000, 112_345_678, (1 << 63) - 1, None, None]
    ticker = '{"type":"ticker","sequence":%s,"product_id":"A, B}","best_bid":"%s","best_bid_size":"1","best_ask":"%s","best_ask_size":"1"}'
    rows_ = [(ticker % (1, "2", "3"),), (ticker % (1, "1e5", "16"),), (ticker % (1, "9" * 20, "3"),), (ticker % ("9" * 30, "2", "3"),), (ticker % (1, "0.00000001", "90000000000"),), (ticker % ("x", "2", "3"),)]
    good, bad = parsers.quarantined(parsers.coinbase_bbo(spark.createDataFrame(rows_, "payload string")))
    assert sorted(r.bid_px8 for r in good.collect()) == [200_000_000, 1_500_000_000] and bad.count() == 4
    assert parsers.message_fields(spark.createDataFrame(rows_[:1], "payload string")).first().product_id == "A, B}"


def test_days_and_seconds_roll(spark):
    texts = ["2023-02-31T00:00:00Z", "2023-01-01T00:00:60Z", "1969-12-31T23:59:59Z", "2023-01-32T00:00:00Z", "2023-01-01T24:00:00Z", "2023-01-01T00:00:00.1234567899Z", "9999-12-31T00:00:00Z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(S.iso_ns(F.col("x"))).collect()]
    assert got == [1_677_801_600_000_000_000, 1_672_531_260_000_000_000, None, None, None, 1_672_531_200_123_456_789, None]


def test_running_values_across_ranges(spark):
    import random

    r = random.Random(4)
    rows_ = [(k, o, r.choice([None, r.randrange(100)])) for k in range(3) for o in sorted(r.sample(range(-500, 500), 200))]
    df = spark.createDataFrame(rows_, "k long, ord long, v long")
    for span in (7, 64, 1 << 18):
        x = ordered.running(df, ["k"], "ord", {"top": ("max", "v"), "low": ("min", "v"), "sum": ("sum", "v")}, span=span)
        x = ordered.running(x, ["k"], "ord", {"top_before": ("max", "v")}, before=True, span=span)
        x = ordered.neighbour(ordered.neighbour(x, ["k"], "ord", {"lag": "v"}, span=span), ["k"], "ord", {"lead": "v"}, after=True, span=span)
        x = ordered.last_known(x, ["k"], "ord", {"known": "v"}, span=span)
        got = {(q.k, q.ord): q for q in x.collect()}
        assert len(got) == len(rows_)
        for k in range(3):
            own = [q for q in rows_ if q[0] == k]
            for i, (_, o, v) in enumerate(own):
                upto, before, q = [w for _, _, w in own[: i + 1] if w is not None], [w for _, _, w in own[:i] if w is not None], got[k, o]
                assert (q.top, q.low, q.sum) == ((max(upto), min(upto), sum(upto)) if upto else (None, None, None))
                assert (q.top_before, q.known) == ((max(before), before[-1]) if before else (None, None))
                assert (q.lag, q.lead, q.v) == (own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None, v)


def test_ladder_by_brute_force(spark):
    import random

    r = random.Random(9)
    rows_ = [(b, i, 10**10, side, 10**10 + r.randrange(-6, 7) * 50_000 * (900 if r.random() < 0.1 else 1), r.choice([0, 0, 3, 5])) for b in (1, 2) for i in range(400) for side in ("bid", "ask")]
    got = {(x.book_id, x.ord): x for x in folds.ladder(spark.createDataFrame(rows_, "book_id long, ord long, base_px8 long, side string, price_px8 long, quantity long")).collect() for _ in (0,)}
    last = [x for x in folds.ladder(spark.createDataFrame(rows_, "book_id long, ord long, base_px8 long, side string, price_px8 long, quantity long")).collect()]
    assert len(last) == len(rows_) and len(got) == 800
    for b in (1, 2):
        slots = {"bid": [(0, 0)] * 2048, "ask": [(0, 0)] * 2048}
        best, want = {"bid": 0, "ask": 2047}, []
        for _, i, base, side, price, qty in sorted((x for x in rows_ if x[0] == b), key=lambda x: (x[1], x[3])):
            slot = abs(price - base) // 100_000
            if slot < 2048:
                book = slots[side]
                book[slot] = (price, qty)
                at, q = book[best[side]]
                if qty > 0 and (q == 0 or (price > at if side == "bid" else price < at)):
                    best[side] = slot
                elif qty == 0 and slot == best[side]:
                    best[side] = 0
                    for j, (p, q) in enumerate(book):  # a scan over all slots; the first of equals stays
                        held = book[best[side]] if book[best[side]][1] > 0 and book[best[side]][0] > 0 else None
                        if q > 0 and p > 0 and (held is None or (p > held[0] if side == "bid" else p < held[0])):
                            best[side] = j
            tops = [x if (x := slots[k][best[k]])[1] > 0 else (None, None) for k in ("bid", "ask")]
            want.append((i, *tops[0], *tops[1]))
        assert sorted(((x.ord, x.bid_px8, x.bid_qty8, x.ask_px8, x.ask_qty8) for x in last if x.book_id == b), key=str) == sorted(want, key=str)


MESSAGES = [
    ("not json", 0), ('{"type":"ticker"}', 1), ('{"type":"ticker","product_id":"C"}', 2), ('{"type":"heartbeat","product_id":"A","sequence":5,"last_trade_id":50}', 3), ('{"type":"subscriptions"}', 4),
    *((f'{{"type":"ticker","sequence":{q},"product_id":"{p}","price":"2","best_bid":"1","best_bid_size":"1","best_ask":"3","best_ask_size":"1","side":"buy","time":"2023-01-01T00:00:00Z","trade_id":{t},"last_size":"1"}}', at) for q, p, t, at in [
        (10, "A", 5, 5), (11, "A", 7, 6), (9, "A", 8, 7), (12, "A", 9, 8), (1, "B", 1, 9), (2, "B", 2, 10), (2, "A", 3, 30_000)]),
    ('{"type":"heartbeat","product_id":"A","sequence":20,"last_trade_id":99}', 30_001), ('{"type":"heartbeat","product_id":"A","sequence":2,"last_trade_id":3}', 30_002), ('{"type":"error"}', 30_003), ('{"type":"ticker","product_id":"A","best_bid":"1"}', 30_004),
]


def plain_session(messages, products, acted, stale_ms=10_000):
    """(action, quote, trade) of each message, and the counters."""
    import json

    seq, tid, most, heard, out = {}, {}, {}, None, []
    n = dict.fromkeys(session.COUNTERS, 0)
    for text, at in messages:
        n["messages"] += 1
        action, quote, trade = None, False, False
        if acted and heard is not None and at - heard > stale_ms:
            action = "stale"
            seq, tid = {}, {}
        heard = at
        try:
            m = json.loads(text)
        except ValueError:
            m = {}
        kind, p = m.get("type"), m.get("product_id")
        if kind is None:
            n["malformed"] += 1
        elif kind == "error":
            action = "error"
        elif kind in ("ticker", "heartbeat"):
            n[kind + "s"] += 1
            if p is None:
                n["malformed"] += 1
            elif p not in products:
                n["unknown_product"] += 1
            elif kind == "ticker" and not {"sequence", "price", "best_bid", "best_bid_size", "best_ask", "best_ask_size", "side", "trade_id", "last_size"} <= set(m):
                n["malformed"] += 1
            else:
                q, t = m["sequence"], m["trade_id" if kind == "ticker" else "last_trade_id"]
                if p in seq and q <= seq[p]:
                    action = "regression"
                    n["sequence_regressions"] += 1
                elif kind == "ticker" and p in tid and t != tid[p] + 1:
                    action = "trade_gap"
                    n["trade_id_gaps"] += 1
                elif kind == "heartbeat" and p in tid and t > tid[p]:
                    action = "heartbeat_behind"
                    n["heartbeat_behind"] += 1
                if kind == "ticker":
                    seq[p], tid[p], quote, trade = q, t, True, t > most.get(p, 0)
                    most[p] = max(t, most.get(p, 0))
                    n["events_emitted"] += 1 + trade
                elif p in seq and q > seq[p]:
                    seq[p] = q
        if acted and action:
            n["reconnects" if action in ("error", "stale") else "resubscribes"] += 1
            seq, tid = {}, {}
        out.append((action, quote, trade))
    return out, n


def test_session_by_brute_force(spark, tmp_path):
    import random

    r = random.Random(3)
    many = [(text, i * 10) for i, (text, _) in enumerate(r.choices(MESSAGES, k=600))]
    for messages in (MESSAGES, many):
        path = tmp_path / f"recording{len(messages)}.jsonl"
        path.write_text("\n\n".join(m[0] for m in messages) + "\n")
        recorded = transports.recording(spark, str(path))
        in_order = [x.payload for x in recorded.orderBy("ord").collect()]
        assert in_order == [m[0] for m in messages]
        df = spark.createDataFrame([(7, i, at, text) for i, (text, at) in enumerate(messages)], "connection long, ord long, now_ms long, payload string")
        read = session.read_messages(df, ["A", "B"])
        for acted in (False, True):
            want, counts = plain_session(messages, ["A", "B"], acted)
            judged = read.join(folds.session(read), ["connection", "ord"]) if acted else session.audit(read, ["connection", "product_id"], span=16)
            assert [(x.action, x.emits_quote, x.emits_trade) for x in judged.orderBy("ord").collect()] == want
            assert session.counters(judged, acted).first().asDict() == counts
        quiet = folds.session(read, stale_ms=1 << 40, reset=False).orderBy("ord").collect()
        assert [x.action for x in quiet] == [x[0] for x in plain_session(messages, ["A", "B"], False)[0]]


def test_dispatch_counts_all_that_happens(spark):
    quote = {f: 1 for f in codec.QUOTE_FIELDS} | {"venue": 1, "market_id": 5, "flags": 0, "spread_bps": 9}
    events = spark.createDataFrame([quote | {"ord": i, "now_ms": 1000 + i} for i in range(4)] + [quote | {"ord": 9, "now_ms": 5000, "market_id": 6}])
    topic = lambda m: (1 << 56) + (m << 32) + (1 << 24)
    subs = spark.createDataFrame([(topic(5), c) for c in (1, 2, 3, 4, 99)] + [(topic(6), 1)], "topic_key long, client_id long")
    clients = spark.createDataFrame([(1, "sbe", 1, 0, 0.0), (2, "json", 2, 0, 0.0), (3, "json", 2, 8, 0.0), (4, "sbe", 3, 0, 0.0)], "client_id long, protocol string, state int, max_spread_bps long, min_notional_usd double")
    sent = router.dispatch(events, subs, clients, 1, 1, 2)
    got = {x.ord: x for x in router.metrics(sent).collect()}
    n = len(events.select(codec.quote_json()).first()[0])
    assert tuple(got[0]) == (0, 5, 2, 1, 0, 92, n) and tuple(got[1]) == (1, 5, 2, 1, 0, 92, n) and tuple(got[3]) == (3, 5, 0, 1, 2, 0, 0) and tuple(got[9]) == (9, 1, 1, 0, 0, 92, 0)
    assert sorted(tuple(x) for x in router.client_counts(sent).collect()) == [(1, 3, 3 * 92, 2), (2, 2, 2 * n, 2)]
    frames = {(x.ord, x.client_id): bytes(x.frame) for x in websocket.broadcast(events, sent, 1).collect()}
    assert len(frames) == 5 and frames[0, 1][:2] == b"\x82\x5c" and codec.QUOTE.unpack(frames[0, 1][2:])[10] == 5
    h = codec.frame_header(frames[0, 2])
    assert (h["opcode"], h["length"]) == (1, n) and frames[0, 2][h["size"] :].startswith(b'{"type":"bbo","market_id":5,')
    long = router.dispatch(events.withColumns({c: F.lit(10**18 - 1) for c in ("sequence", "t0_ns", "t1_ns", "t2_ns", "t3_ns")}), subs, clients, 1)
    assert router.metrics(long).agg(F.sum("delivered")).first()[0] == 9 and codec.MOST_JSON == 512


def test_packed_messages(spark):
    rows_ = [{f: i + 1 + k for i, f in enumerate(codec.QUOTE_FIELDS)} for k in range(3)]
    df = spark.createDataFrame(rows_)
    sent = codec.encode(df, 1)
    assert all(bytes(x.sbe) == codec.QUOTE.pack(*codec.QUOTE_HEADER, *(x[f] for f in codec.QUOTE_FIELDS)) for x in sent.collect())
    back = codec.decode(sent.select("sbe").unionByName(spark.createDataFrame([(bytearray(50),), (None,), (bytearray(100),), (bytearray(codec.QUOTE.pack(84, 102, 1, 1, *range(14)) + b"tail"),), (bytearray(codec.QUOTE.pack(1, 101, 1, 9, *range(14)) + b"tail"),)], "sbe binary")), 1).collect()
    assert [x.error for x in back] == [None] * 3 + ["too small", "too small", "bad schema", "bad template", None]
    assert [x.message.asDict() for x in back[:3]] == rows_ and back[-1].message.flags == 13
    trade = {f: 1 for f in codec.TRADE_FIELDS[:12]} | {"price_px8": 123_456_789_012_345_678, "size_qty8": 987_654_321_098, "is_liquidation": True}
    got = codec.decode(codec.encode(spark.createDataFrame([trade, trade | {"price_px8": -5}]), 3), 3).collect()
    fields = [codec.TRADE.unpack(bytes(x.sbe)) for x in got]
    assert fields[0][16] == 123_456_789_012_345_678 * 987_654_321_098 // 10**8 & codec.MASK63 and fields[1][16] == 0 and fields[0][4 + 14 :] == (1, 1, 0)
    assert got[0].message.asDict() == trade


def test_websocket_answers(spark):
    mask = lambda f: f[:1] + bytes([f[1] | 128]) + b"\1\2\3\4" + codec.unmasked(f[2:], b"\1\2\3\4")
    ask = b'{"action":"subscribe","venue":201,"market_id":3,"stream_type":1,"flags":0}'
    data = [codec.frame(9, b"beat"), mask(codec.frame(9, b"beat")), codec.frame(8, b""), mask(codec.frame(1, ask)), codec.frame(1, b'{"action":"ping"}'), codec.frame(1, b"hello"), b"\x81", codec.frame(3, b""), codec.frame(9, b"x" * 300), codec.frame(10, b""), codec.frame(1, ask)[:-1]]
    frames = spark.createDataFrame([(1, i, 77, bytearray(d)) for i, d in enumerate(data)] + [(2, 20, 77, bytearray(codec.frame(1, ask)))], "client_id long, ord long, now_ms long, data binary")
    answered = websocket.answers(frames, spark.createDataFrame([(1,)], "client_id long"))
    got = {x.ord: (x.event, x.error, None if x.response is None else bytes(x.response)) for x in answered.collect()}
    assert got[0] == got[1] == ("ping", None, codec.frame(10, b"beat")) and got[2] == ("disconnect", None, codec.frame(8, b""))
    assert got[3] == ("subscribe", None, codec.frame(1, b'{"type":"subscribed","topic":%d}' % ((201 << 56) + (3 << 32) + (1 << 24))))
    assert got[4] == ("ping", None, codec.frame(1, b'{"type":"pong","ts":77}')) and got[5] == ("ignored", None, None)
    assert got[6][1:] == got[10][1:] == ("incomplete", None) and got[7][1] == "invalid opcode" and got[8] == ("ping", "buffer too small", None) and got[9] == ("pong", None, None) and got[20] == ("subscribe", "not found", None)
    assert [(x.client_id, x.kind) for x in websocket.commands(answered).orderBy("ord").collect()] == [(1, "unregister"), (1, "subscribe"), (2, "subscribe")]


def test_queue_with_pops(spark):
    import random
    from collections import deque

    r = random.Random(2)
    ops = [(q, i, r.choice(["push", "push", "pop"])) for q in range(3) for i in range(80)]
    df = spark.createDataFrame(ops, "queue long, ord long, op string")
    for oldest in (True, False):
        want = []
        for q in range(3):
            held = deque()
            for _, i, op in (x for x in ops if x[0] == q):
                if op == "pop":
                    want.append((q, i, "popped", held.popleft()) if held else (q, i, "empty", None))
                elif len(held) < 4:
                    held.append(i)
                    want.append((q, i, "enqueued", None))
                else:
                    want.append((q, i, "evicted", held.popleft()) if oldest else (q, i, "dropped", None))
                    if oldest:
                        held.append(i)
        done = folds.queue(df, 4, oldest)
        assert sorted(map(str, (tuple(x) for x in done.collect()))) == sorted(map(str, want))
        for x in folds.queue_counters(done).collect():
            mine = [w[2] for w in want if w[0] == x.queue]
            assert (x.enqueued, x.dropped, x.evicted, x.consumed, x.saturations) == (mine.count("enqueued"), mine.count("dropped"), mine.count("evicted"), mine.count("popped"), mine.count("dropped") + mine.count("evicted"))


def test_transports(spark, tmp_path):
    import socket
    import time

    drop = transports.Drop(str(tmp_path / "packets"))
    for i in range(5):
        drop.push(f"p{i}", 100 + i)
    assert [(x.ord, x.payload, x.t1_ns) for x in drop.frame(spark).orderBy("ord").collect()] == [(i, f"p{i}", 100 + i) for i in range(5)]
    sizes = []
    drop.stream(spark, 2).writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [2, 2, 1]
    drop.active = False
    with pytest.raises(transports.NotConnected):
        drop.stream(spark)
    reader = transports.DatagramReader({"port": "0", "batch": "8", "pool": "3", "entry": "4"})
    to, sender = reader.bound().getsockname(), socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for i in range(5):
        sender.sendto(b"packet%d" % i, to)
    time.sleep(0.2)
    got, end = reader.read(reader.initialOffset())
    assert [x[0] for x in got] == ["pack"] * 3 and end == {"packets": 3, "bytes": 12, "polls": 1, "empty_polls": 0, "overruns": 2}
    assert [x[0] for x in reader.readBetweenOffsets(reader.initialOffset(), end)] == ["pack"] * 3
    assert reader.read(end)[1]["empty_polls"] == 1
    reader.commit(end)
    assert not reader.held.get(0)
    assert transports.best(1, {"completion"}) == "completion" and transports.best(2, {"bypass"}) == "socket"
    with pytest.raises(ValueError, match="no transport"):
        transports.reader(spark, "pigeon")


def test_datagram_stream(spark, tmp_path):
    import socket
    import time

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    stream = transports.reader(spark, "socket", port=port)
    q = stream.writeStream.format("memory").queryName("datagrams").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    sender, deadline = socket.socket(socket.AF_INET, socket.SOCK_DGRAM), time.time() + 40
    while time.time() < deadline and spark.table("datagrams").count() < 3:
        sender.sendto(b"hello", ("127.0.0.1", port))
        time.sleep(0.3)
    q.stop()
    assert {x.payload for x in spark.table("datagrams").collect()} == {"hello"}


def test_sinks(spark, tmp_path):
    from tickforge.sources import adapters as A
    from tickforge.streaming import sinks

    quotes = A.bbo(spark, DATA)
    quotes.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(quotes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sinks.publish(stream(), str(tmp_path / "ring"), str(tmp_path / "c1"))
    q.awaitTermination()
    held = rings.content(spark.read.parquet(str(tmp_path / "ring")).select("market_id", "ord"))
    want = catalogue.QUERIES["ring_read"](spark, DATA)
    assert rows(["market_id", "ord", "seq"], [tuple(x) for x in held.select("market_id", "ord", "seq").collect()]) == rows(["market_id", "ord", "seq"], [tuple(x) for x in want.select("market_id", "ord", "seq").collect()])
    sinks.deliver(stream(), A.subscriptions(spark, DATA), A.clients(spark, DATA), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    frames, counts = spark.read.parquet(str(tmp_path / "out/frames")), spark.read.parquet(str(tmp_path / "out/counts"))
    assert frames.count() == counts.agg(F.sum("delivered")).first()[0] > 0 and counts.filter("process_ns < 500").count() == 0
    assert sinks.health("/healthz", [], 1, 2) == (200, "OK") and sinks.health("/readyz", [q], 1, 2)[0] == 503 and sinks.health("/x", [], 1, 2)[0] == 404
    text = sinks.health("/metrics", [q], 12, 2)[1]
    assert f"tickforge_ticks_processed_total {quotes.count()}\n" in text and "tickforge_uptime_seconds 12\n" in text and "tickforge_active_tier 2\n" in text


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
