"""Queries of documents, conversations, path spectra and streams."""

from pyspark.sql import functions as F

from tidemark.functions import windows as X
from tidemark.operators import features as O
from tidemark.operators import retrieval as R
from tidemark.operators import spectrum as G
from tidemark.operators import text as T
from tidemark.plans.features import r6
from tidemark.plans.registry import query
from tidemark.sources import canonical as K
from tidemark.sources.canonical import BARS_1H, with_
from tidemark.streaming import ops as S
from tidemark.streaming import pairs as P
from tidemark.streaming import tables as V


def _entries(spark, d):
    """Entries made of the nations: some headers have faults."""
    n = K.table(spark, d, "nation")
    k = F.col("n_nationkey")
    head = F.concat(F.lit("---\nslug: "), F.lower("n_name"), F.lit("\ntitle: "), "n_name", F.lit("\nstatus: "), F.when(k % 4 == 0, "lost").otherwise("active"), F.when(k % 5 == 0, "\nodd: 1").otherwise(""), F.when(k % 6 == 0, "\ncreated: 2024-02-30").otherwise("\ncreated: 2024-02-01"), F.lit("\n---\nbody "), "n_name")
    return n.select("n_nationkey", "n_name", F.when(k % 7 == 0, F.concat(F.lit("no header "), "n_name")).otherwise(head).alias("text"))


@query("o701_front_matter", "SELECT n_nationkey, CASE WHEN k % 7 = 0 THEN NULL ELSE lower(n_name) END AS slug, CASE WHEN k % 7 = 0 THEN 'no header' ELSE array_to_string(list_sort(list_filter([CASE WHEN k % 4 = 0 THEN 'bad status' END, CASE WHEN k % 5 = 0 THEN 'unknown odd' END, CASE WHEN k % 6 = 0 THEN 'bad date created' END], lambda x: x IS NOT NULL)), ';') END AS errors FROM (SELECT *, n_nationkey AS k FROM nation)")
def o701(spark, d):
    f = T.front_matter(_entries(spark, d))
    return f.select("n_nationkey", F.try_element_at("fields", F.lit("slug")).alias("slug"), F.array_join("errors", ";").alias("errors"))


@query("o702_list_and_date", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name || ',x' END AS items, CASE WHEN n_nationkey % 2 = 0 THEN DATE '2024-03-05' END AS day FROM nation")
def o702(spark, d):
    n = K.table(spark, d, "nation")
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, F.concat(F.lit('["'), "n_name", F.lit('", "x"]'))).when(k % 3 == 1, '["a", 1]').otherwise("a, b")
    return n.select("n_nationkey", F.array_join(T.string_list(text), ",").alias("items"), T.iso_date(F.when(k % 2 == 0, "2024-03-05").otherwise("2024-3-5")).alias("day"))


@query("o703_quote_block", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN NULL ELSE NULL END AS core FROM nation")
def o703(spark, d):
    n = K.table(spark, d, "nation")
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("intro\n> "), "n_name", F.lit("\nrest\n```x\n> not this\n```\n"))).when(k % 3 == 1, "> a\n\ntext\n\n> b\n").otherwise("none")
    return n.select("n_nationkey", T.quote_block(text).alias("core"))


@query("o704_fenced_blocks", "SELECT n_nationkey, n_name || ';two' AS blocks FROM nation")
def o704(spark, d):
    t = F.concat(F.lit("x\n```note\n"), "n_name", F.lit("\n```\ny\n```other\nno\n```\n```note\ntwo\n```"))
    return K.table(spark, d, "nation").select("n_nationkey", F.array_join(T.fenced_blocks(t, "note"), ";").alias("blocks"))


@query("o705_collisions", "WITH x AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation UNION SELECT n_nationkey, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT name, count(DISTINCT k) AS entries FROM x GROUP BY name HAVING count(DISTINCT k) > 1")
def o705(spark, d):
    n, r = K.table(spark, d, "nation"), K.table(spark, d, "region")
    e = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("k"), "n_name", F.array("r_name").alias("aliases"))
    return T.collisions(e, "k", ["n_name", "aliases"])


@query("o705_successors", "SELECT n_nationkey AS slug, n_nationkey + 3 AS superseded_by FROM nation a WHERE n_nationkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM nation b WHERE b.n_nationkey = a.n_nationkey + 3 AND b.n_nationkey % 5 <> 0)")
def o705b(spark, d):
    k = F.col("n_nationkey")
    e = K.table(spark, d, "nation").select(k.alias("slug"), F.when(k % 2 == 0, k + 3).alias("superseded_by"), F.when(k % 5 == 0, "retired").otherwise("active").alias("status"))
    return T.broken_successors(e)


@query("o706_named_matches", "SELECT DISTINCT d.doc_id, b.item_id AS id FROM (SELECT doc_id, lower(regexp_replace(text, '[\\p{P}\\p{Z}\\s]', '', 'g')) AS norm FROM documents) d, (SELECT item_id, lower(regexp_replace(text, '[\\p{P}\\p{Z}\\s]', '', 'g')) AS needle FROM benchmark) b WHERE contains(norm, needle)")
def o706(spark, d):
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\p{P}\p{Z}\s]", "")
    return T.named_matches(K.table(spark, d, "documents").select("doc_id", plain("text").alias("norm")), K.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), plain("text").alias("needle")), "doc_id")


@query("o706_normalize")
def o706b(spark, d):
    return K.table(spark, d, "documents").select("doc_id", T.normalized(F.col("text"), ("the",)).alias("norm"))


@query("o707_context_relevance", "SELECT doc_id, CASE WHEN source = 'src1' THEN 3 WHEN lang = 'fr' AND n_chars > 2000 THEN 2 WHEN lang = 'fr' OR n_chars > 2000 THEN 1 ELSE 0 END AS score FROM documents")
def o707(spark, d):
    return K.table(spark, d, "documents").select("doc_id", T.relevance(F.col("source") == "src1", F.col("lang") == "fr", F.col("n_chars") > 2000).alias("score"))


@query("o708_select_under_budget", """WITH RECURSIVE r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents),
g AS (SELECT source, k, doc_id, n_chars, n_chars <= 8000 AS ok, 8000 - CASE WHEN n_chars <= 8000 THEN n_chars ELSE 0 END AS room FROM r WHERE k = 1
  UNION ALL SELECT r.source, r.k, r.doc_id, r.n_chars, r.n_chars <= g.room, g.room - CASE WHEN r.n_chars <= g.room THEN r.n_chars ELSE 0 END FROM g JOIN r ON r.source = g.source AND r.k = g.k + 1)
SELECT source, doc_id FROM g WHERE ok""")
def o708(spark, d):
    docs = K.table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return T.within_budget(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], "n_chars", T.NAMED_CHARS).select("source", "doc_id")


def _retrieved(spark, d, how=R.retrieve):
    """Suppliers as a library, orders as contexts: each asks for its customer's nation and priority, every ninth by a supplier's name."""
    k = F.col("s_suppkey")
    s, n, r = (K.table(spark, d, t) for t in ("supplier", "nation", "region"))
    places = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("key"), "n_name", "r_name")  # two fixed, tiny dimensions
    pick = lambda test, *xs: F.when(test, F.array(*xs)).otherwise(F.array().cast("array<string>"))
    lib = s.join(F.broadcast(places), F.col("s_nationkey") == F.col("key")).select(
        F.lower("s_name").alias("slug"), F.col("s_name").alias("title"), F.array().cast("array<string>").alias("aliases"), pick(k % 3 == 0, F.col("n_name")).alias("symbols"), pick(k % 2 == 0, F.lit("1-URGENT"), F.lit("2-HIGH")).alias("regimes"), pick(k % 3 == 1, F.col("r_name")).alias("classes"),
        F.when(k % 5 == 4, "archived").otherwise("active").alias("status"), F.lit("").alias("superseded_by"), F.lit("old").alias("archive_reason"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("updated"),
        F.concat("s_name", F.lit(" & "), F.repeat(F.col("n_name"), (k % 17 + 1).cast("int"))).alias("line"), F.repeat(F.col("n_name"), (k % 90 + 1).cast("int")).alias("decision"), F.repeat(F.col("n_name"), (k % 700 + 1).cast("int")).alias("archive"),
    )
    o, c = K.table(spark, d, "orders"), K.table(spark, d, "customer")
    key = F.col("o_orderkey")
    subject = F.struct(F.col("n_name").alias("symbol"), F.col("r_name").alias("class"), F.when(key % 4 == 0, "far").otherwise("near").alias("bucket"), F.array("o_orderpriority").alias("regimes"))
    ask = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(places), F.col("c_nationkey") == F.col("key"))
    ask = ask.select(key.alias("context_id"), F.when(key % 3 == 0, "overview").otherwise("symbol").alias("scope"), F.array(subject).alias("subjects"), F.when(key % 9 == 0, F.concat(F.lit("Supplier#"), F.lpad((key % 10 + 1).cast("string"), 9, "0"))).otherwise("-").alias("text"))
    return how(lib, ask)


@query("o708_index_lines", f"""WITH RECURSIVE pl AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
li AS (SELECT lower(s_name) AS slug, s_suppkey AS k, n_name, r_name, length(s_name) + 7 + length(n_name) * (s_suppkey % 17 + 1) + 3 AS size, s_suppkey % 28 AS day FROM supplier JOIN pl ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 4),
co AS (SELECT DISTINCT n_name AS sym, r_name AS cls, o_orderpriority AS pri, o_orderkey % 3 = 0 AS overview, o_orderkey % 4 <> 0 AS near, CASE WHEN o_orderkey % 9 = 0 THEN 'supplier#' || lpad((o_orderkey % 10 + 1)::VARCHAR, 9, '0') END AS named FROM orders JOIN customer ON o_custkey = c_custkey JOIN pl ON c_nationkey = n_nationkey),
sc AS (SELECT co.*, slug, size, CASE WHEN (k % 3 = 0 AND li.n_name = sym OR k % 3 = 2) THEN CASE WHEN (k % 2 = 1 OR pri IN ('1-URGENT', '2-HIGH')) AND (NOT overview OR near) THEN 3 ELSE 2 END WHEN k % 3 = 1 AND li.r_name = cls THEN 1 ELSE 0 END AS score, coalesce(slug = named, false) AS hit, day FROM co CROSS JOIN li),
rk AS (SELECT *, row_number() OVER c AS i, count(*) OVER (PARTITION BY sym, pri, overview, near, named) AS n FROM sc WINDOW c AS (PARTITION BY sym, pri, overview, near, named ORDER BY hit DESC, score DESC, day DESC, slug DESC)),
g AS (SELECT sym, pri, overview, near, named, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS kept, '' AS lines, max(n) AS n FROM rk GROUP BY ALL
  UNION ALL SELECT g.sym, g.pri, g.overview, g.near, g.named, rk.i, CASE WHEN {{fits}} THEN used + size ELSE used END, CASE WHEN {{fits}} THEN kept + 1 ELSE kept END, CASE WHEN {{fits}} THEN lines || ',' || slug ELSE lines END, g.n FROM g JOIN rk ON rk.sym = g.sym AND rk.pri = g.pri AND rk.overview = g.overview AND rk.near = g.near AND rk.named IS NOT DISTINCT FROM g.named AND rk.i = g.i + 1)
SELECT o_orderkey AS context_id, substr(lines, 2) AS lines, kept FROM orders JOIN customer ON o_custkey = c_custkey JOIN pl ON c_nationkey = n_nationkey
JOIN g ON g.i = g.n AND sym = n_name AND pri = o_orderpriority AND overview = (o_orderkey % 3 = 0) AND near = (o_orderkey % 4 <> 0) AND named IS NOT DISTINCT FROM CASE WHEN o_orderkey % 9 = 0 THEN 'supplier#' || lpad((o_orderkey % 10 + 1)::VARCHAR, 9, '0') END""".replace("{fits}", f"{R.FRAME} + used + size + CASE WHEN g.n - kept - 1 > 0 THEN length((g.n - kept - 1)::VARCHAR) + {sum(map(len, R.INDEX_LEFT_OUT)) + 1} ELSE 0 END <= {T.INDEX_CHARS}"))
def o708b(spark, d):
    return _retrieved(spark, d, R.index_lines).select("context_id", F.array_join("index", ",").alias("lines"), F.size("index").cast("long").alias("kept"))


@query("o708_retrieval")
def o708c(spark, d):
    return _retrieved(spark, d)


@query("o709_without_digits", "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS url FROM pages")
def o709(spark, d):
    return K.table(spark, d, "pages").select("page_id", T.without_digits(F.col("url")).alias("url"))


@query("o710_recent_states", "SELECT user_id AS symbol, list_sort(list(DISTINCT event_type)) AS states FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 5 DAY GROUP BY 1")
def o710(spark, d):
    e = K.table(spark, d, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_type").alias("state"))
    return T.recent_states(e, 5, F.lit("2024-01-31").cast("timestamp_ntz"))


@query("o711_chat_tail", "SELECT user_id, event_id, CASE WHEN m >= 15 THEN floor(m)::BIGINT END AS gap_min FROM (SELECT *, (epoch(time_bucket(INTERVAL 1 SECOND, ts, TIMESTAMP '1970-01-01')) - epoch(time_bucket(INTERVAL 1 SECOND, lag(ts) OVER w, TIMESTAMP '1970-01-01'))) / 60 AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE rn <= 8")
def o711(spark, d):
    return T.chat_tail(K.table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], 8, "ts").select("user_id", "event_id", "gap_min")


@query("o712_escaped_html", "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def o712(spark, d):
    return K.table(spark, d, "pages").select("page_id", F.sha2(T.escaped(F.col("html")), 256).alias("digest"))


# ---------------------------------------------------------------- spectrum

_SC = G.SCALES
_DEC = "m0 AS (SELECT symbol, ts, close AS m0 FROM bars_1h), " + ", ".join(f"m{i + 1} AS (SELECT *, avg(m{i}) OVER (PARTITION BY symbol ORDER BY ts ROWS {w - 1} PRECEDING) AS m{i + 1} FROM m{i})" for i, w in enumerate(_SC))
_DEC += ", dc AS (SELECT symbol, ts, " + ", ".join(f"m{i} - m{i + 1} AS d{w}" for i, w in enumerate(_SC)) + f", m{len(_SC)} AS trend FROM m{len(_SC)})"
_PARTS = [*(f"d{w}" for w in _SC), "trend"]


@query("o801_decompose", with_(BARS_1H, _DEC) + "SELECT symbol, ts, " + ", ".join(f"round({c} + 3e-8::DOUBLE, 6) AS {c}" for c in _PARTS) + " FROM dc")
def o801(spark, d):
    return G.decompose(K.bars_1h(spark, d)).select("symbol", "ts", *[r6(F.col(c) + 3e-8, c) for c in _PARTS])  # apart from halves


_EN = "es AS (SELECT symbol, " + ", ".join(f"sum(d{w} * d{w}) AS d{w}" for w in _SC) + ", var_pop(trend) * count(*) AS trend FROM dc GROUP BY symbol), en AS (SELECT symbol, " + ", ".join(f"{c} / ({' + '.join(_PARTS)}) AS {c}" for c in _PARTS) + " FROM es)"


@query("o802_energy_spectrum", with_(BARS_1H, _DEC, _EN) + "SELECT symbol, " + ", ".join(f"round({c} + 3e-8::DOUBLE, 6) AS {c}" for c in _PARTS) + " FROM en")
def o802(spark, d):
    return G.energies(G.decompose(K.bars_1h(spark, d))).select("symbol", *[r6(F.col(c) + 3e-8, c) for c in _PARTS])


@query("o803_theil_sen")
def o803(spark, d):
    return G.theil_sen(K.bars_1h(spark, d))


@query("o804_path_state")
def o804(spark, d):
    t = G.theil_sen(K.bars_1h(spark, d))
    return t.select("symbol", "ts", G.path_state(F.col("tau"), F.col("snr"), F.col("amp"), F.col("crossings")).alias("state"))


@query("o805_membership")
def o805(spark, d):
    t = G.theil_sen(K.bars_1h(spark, d))
    return t.select("symbol", "ts", G.membership(F.col("tau"), F.col("snr"), F.col("amp"), F.col("crossings")).alias("m")).select("symbol", "ts", "m.*")


@query("o806_calibrate", with_(BARS_1H) + """, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n FROM bars_1h),
w AS (SELECT symbol, n // 48 AS w, list(close ORDER BY n) AS a FROM n GROUP BY 1, 2 HAVING count(*) = 48),
s AS (SELECT symbol, w, median((a[j] - a[i]) / (j - i)) AS slope FROM (SELECT symbol, w, a, i, unnest(range(i + 1, 49)) AS j FROM (SELECT symbol, w, a, unnest(range(1, 48)) AS i FROM w)) GROUP BY 1, 2),
r AS (SELECT symbol, w, list_transform(a, lambda y, k: y - (list_median(a) - slope * 23.5::DOUBLE) - slope * (k - 1)) AS r, list_avg(a) AS m FROM w JOIN s USING (symbol, w)),
v AS (SELECT symbol, sqrt(list_avg(list_transform(r, lambda x: x * x))) / m * 100 AS amp FROM r)
SELECT symbol, round(quantile_cont(amp, 0.298), 6) AS threshold, count(*) AS windows FROM v GROUP BY symbol HAVING count(*) >= 10""")
def o806(spark, d):
    """Windows of 48 bars, of which the test tables have ten and more."""
    return G.calibrate(K.bars_1h(spark, d), 48).select("symbol", r6("threshold"), "windows")


@query("o807_continuous", with_(BARS_1H) + ", c AS (SELECT symbol, ts, CASE WHEN (row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1) % 2 = 0 THEN close END AS v FROM bars_1h) SELECT symbol, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM c")
def o807(spark, d):
    return G.continuous(K.bars_1h(spark, d), "close").select("symbol", "ts", "known")


_DETAIL, _COARSE = (" + ".join(f"d{w}" for w in _SC if w >= least) for least in (0, G.COARSE))


@query("o808_spectrum_summary", with_(BARS_1H, _DEC, _EN) + f"SELECT symbol, round(trend + 3e-8::DOUBLE, 6) AS trend_share, CAST(CASE {' '.join(f'WHEN d{w} = greatest({", ".join(_PARTS[:-1])}) THEN {w}' for w in _SC)} END AS INTEGER) AS scale, round(({_COARSE}) / ({_DETAIL} + 1e-12) + 3e-8::DOUBLE, 6) AS coarse_share FROM en")
def o808(spark, d):
    return G.dominant(G.energies(G.decompose(K.bars_1h(spark, d)))).select("symbol", r6(F.col("trend_share") + 3e-8, "trend_share"), "scale", r6(F.col("coarse_share") + 3e-8, "coarse_share"))


# ---------------------------------------------------------------- streams


def _stream(spark, d, late=1800):
    """The events in six files, some rows late."""
    e = K.table(spark, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("symbol"), "value")
    return S.in_files(e, f"{S.work_dir(spark)}/events", late_seconds=late)


_END = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
_TUMBLE = "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')"


@query("o904_stream_tumbling", f"SELECT event_type AS symbol, {_TUMBLE} AS ts, count(*) AS n, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2 HAVING {_TUMBLE} + INTERVAL 4 HOUR <= {_END}")
def o904(spark, d):
    return S.run(S.bars(_stream(spark, d)), S.work_dir(spark)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("o905_stream_sliding", f"SELECT event_type AS symbol, s AS ts, count(*) AS n, max(value) AS high, min(value) AS low FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR FOR k IN range(0, 4)]) AS s FROM events) GROUP BY 1, 2 HAVING s + INTERVAL 24 HOUR <= {_END}")
def o905(spark, d):
    return S.run(S.bars(_stream(spark, d), "24 hours", slide="6 hours"), S.work_dir(spark)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("o906_stream_sessions", f"WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 8 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 8 HOUR <= {_END}")
def o906(spark, d):
    s = S.run(S.sessions(_stream(spark, d), "user_id", "8 hours"), S.work_dir(spark))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_ts", "end_ts")})


@query("o908_stream_forming_bar", "SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def o908(spark, d):
    s = S.upsert_latest(_stream(spark, d).select("user_id", "ts", "value"), ["user_id"], S.work_dir(spark))
    return s.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_CONFIRM = """WITH RECURSIVE raw AS (SELECT event_type AS symbol, ts, CASE WHEN value > 12 THEN 'high_vol_chop' WHEN value > 8 THEN 'trend_up' ELSE 'range' END AS state, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events),
f AS (SELECT symbol, rn, ts, state, state AS cur, CAST(NULL AS VARCHAR) AS pend, 0 AS cnt FROM raw WHERE rn = 1
  UNION ALL SELECT symbol, rn, ts, state, CASE WHEN fired THEN state ELSE cur END, CASE WHEN state = cur OR fired THEN NULL ELSE state END, CASE WHEN state = cur OR fired THEN 0 ELSE c END
  FROM (SELECT raw.symbol, raw.rn, raw.ts, raw.state, f.cur, CASE WHEN raw.state = f.pend THEN f.cnt + 1 ELSE 1 END AS c, raw.state <> f.cur AND (CASE WHEN raw.state = f.pend THEN f.cnt + 1 ELSE 1 END) >= (CASE raw.state WHEN 'high_vol_chop' THEN 1 WHEN 'range' THEN 3 ELSE 2 END) AS fired
    FROM f JOIN raw ON raw.symbol = f.symbol AND raw.rn = f.rn + 1))
"""


@query("o909_stream_confirm", _CONFIRM + "SELECT symbol, cur AS confirmed, count(*) AS n, count(*) FILTER (state = 'high_vol_chop') AS n_chop FROM f GROUP BY 1, 2")
def o909(spark, d):
    raw = F.when(F.col("value") > 12, "high_vol_chop").when(F.col("value") > 8, "trend_up").otherwise("range")
    s = S.run(S.confirm(_stream(spark, d, late=0).select("symbol", "ts", raw.alias("raw_state"))), S.work_dir(spark))
    return s.groupBy("symbol", "confirmed").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_state") == "high_vol_chop").alias("n_chop"))


@query("o909_stream_confirmed_states", _CONFIRM + "SELECT symbol, ts, state AS raw_state, cur AS confirmed FROM f")
def o909b(spark, d):
    raw = F.when(F.col("value") > 12, "high_vol_chop").when(F.col("value") > 8, "trend_up").otherwise("range")
    s = S.run(S.confirm(_stream(spark, d, late=0).select("symbol", "ts", raw.alias("raw_state"))), S.work_dir(spark))
    return s.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("o909_stream_pair_states")
def o909c(spark, d):
    """The machine of every pair of hourly returns, fed by six files with late rows: the bars that the watermark has passed."""
    hourly = O.panel_returns(K.bars_1h(spark, d), 3600).select("symbol", "ts", "r")
    names = hourly.select("symbol").distinct()
    pairs = names.select(F.col("symbol").alias("a")).join(names.select(F.col("symbol").alias("b")), F.col("a") < F.col("b"))  # the names of a panel, not rows
    pairs.write.parquet(f"{(folder := S.work_dir(spark))}/pairs")  # once: a stream reads its static side again with every batch
    pairs = spark.read.parquet(f"{folder}/pairs")
    with P.rocksdb(spark):
        s = S.run(P.pair_states(S.in_files(hourly, f"{S.work_dir(spark)}/hours", late_seconds=7200), pairs, late="2 hours"), S.work_dir(spark))
    return s.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("o910_stream_dedup", "SELECT user_id, event_type AS symbol, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def o910(spark, d):
    s = _stream(spark, d)
    twice = s.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_k")
    return S.run(S.first_wins(twice, ["event_id"]), S.work_dir(spark)).groupBy("user_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("o901_stream_watermark", "SELECT event_type AS symbol, max(ts) AS seen FROM events GROUP BY 1")
def o901(spark, d):
    return S.watermark(_stream(spark, d), "symbol", S.work_dir(spark)).withColumn("seen", F.col("seen").cast("timestamp_ntz"))


@query("o907_stream_recompute", """WITH t AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2) SELECT symbol, ts, round(avg(v) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING), 6) AS mean6 FROM t""")
def o907(spark, d):
    """Hourly means that arrive once wrong and late and once right; a mean over six of them is derived anew from the first changed hour on."""
    def derive(bars):
        return bars.groupBy("symbol", "ts").agg(F.avg("value").alias("v")).select("symbol", "ts", F.avg("v").over(X.rows(6)).alias("mean6"))

    # arrivals as files of their own, a batch each: some hours wrong, then some right, then all
    folder = S.work_dir(spark)
    table = K.table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts")).agg(F.avg("value").alias("value"))
    for arrived, part in enumerate((table.where("hour(ts) % 2 = 0").withColumn("value", F.lit(-1.0)), table.where("hour(ts) % 3 <> 0"), table)):
        part.withColumn("arrived", F.lit(arrived)).coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    stream = spark.readStream.schema("symbol string, ts timestamp, value double, arrived int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    got = S.recompute(stream, f"{folder}/out", derive, 5)
    return got.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), r6("mean6"))


_SCANNED = "WHERE ts > CASE symbol WHEN 'view' THEN TIMESTAMP '2024-01-10' WHEN 'click' THEN TIMESTAMP '2024-01-12' ELSE TIMESTAMP '2020-01-01' END"


@query("o902_versioned_scan", with_(BARS_1H) + "SELECT symbol, ts, CASE WHEN symbol = 'view' THEN 'r1' ELSE 'r2' END AS version, round(close, 6) AS close, CASE WHEN symbol <> 'view' THEN top END AS through FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS top FROM bars_1h) WHERE CASE WHEN symbol = 'view' THEN close < 6 ELSE close < 8 END")
def o902(spark, d):
    """A scan of all bars by one version of the rules, then by the next of all symbols but one, and one that breaks off before its commit: at each
    bar stands what the last committed scan found, with the second version's watermark."""
    bars = K.bars_1h(spark, d).select("symbol", "ts", "close")
    scans = V.Scans(spark, f"{S.work_dir(spark)}/scans")
    at = scans.replace(scans.tables.pin(), bars, bars.where("close < 6"), "r1")
    some = bars.where("symbol <> 'view'")
    scans.tables.stage("rows", some.select("symbol", "ts", F.lit(9).cast("long").alias("commit"), F.lit("r3").alias("version"), F.lit("{}").alias("found")))  # broken off
    at = scans.replace(at, some, some.where("close < 8"), "r2")
    found = scans.results(at).select("symbol", "ts", "version", F.round(F.get_json_object("found", "$.close").cast("double"), 6).alias("close"))
    return found.join(scans.marks("r2", at), "symbol", "left")


@query("o903_confirmation_watermark", "WITH v AS (SELECT user_id % 50 AS name, CAST(date_trunc('day', ts) AS DATE) AS day, event_type = 'purchase' AND day(ts) < 20 AS official, event_id, value FROM events), b AS (SELECT name, day, official, arg_max(value, event_id) AS value FROM v GROUP BY 1, 2, 3), m AS (SELECT *, max(day) FILTER (official) OVER (PARTITION BY name) AS confirmed_through FROM b) SELECT name, day, official, round(value, 6) AS value, confirmed_through FROM m WHERE official OR confirmed_through IS NULL OR day > confirmed_through")
def o903(spark, d):
    """Official and provisional values of days arrive in six files, some late."""
    arrived = S.upsert_latest(
        _stream(spark, d).select((F.col("user_id") % 50).alias("name"), F.to_date("ts").alias("day"), ((F.col("symbol") == "purchase") & (F.dayofmonth("ts") < 20)).alias("official"), F.timestamp_micros(F.col("event_id")).alias("ts"), "event_id", "value"), ["name", "day", "official"], S.work_dir(spark)
    )
    return V.confirmed(arrived, ["name"], "day", F.col("official"), "value", "event_id").withColumn("value", F.round("value", 6))


@query("o912_work_budget", with_(BARS_1H) + f""", n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars_1h {_SCANNED}), c AS (SELECT symbol, max(k) AS new FROM n GROUP BY symbol),
e AS (SELECT s.symbol, coalesce(new, 0) AS new, (row_number() OVER (ORDER BY s.symbol) - 1 - 3 + 5 * count(*) OVER ()) % count(*) OVER () AS place FROM (SELECT DISTINCT symbol FROM bars_1h) s LEFT JOIN c USING (symbol)),
q AS (SELECT symbol, place, greatest(0, least(new, 900 - (sum(new) OVER (ORDER BY place) - new))) AS quota FROM e) SELECT symbol, ts, place FROM n JOIN q USING (symbol) WHERE k <= quota""")
def o912(spark, d):
    """What the cycle that begins with the fourth symbol looks at."""
    marks = spark.sql("SELECT symbol, cast(w AS timestamp_ntz) AS through FROM VALUES ('view', '2024-01-10'), ('click', '2024-01-12') AS t(symbol, w)")
    return V.share_budget(K.bars_1h(spark, d), marks, 900, 3).select("symbol", "ts", "place")


@query("o913_pinned_snapshot", with_(BARS_1H) + "SELECT symbol, count(*) FILTER (close < 6) AS n_found, max(ts) AS through FROM bars_1h WHERE ts < TIMESTAMP '2024-01-15' GROUP BY symbol")
def o913(spark, d):
    """Two tables read through one snapshot, with a writer between the two reads."""
    bars = K.bars_1h(spark, d).select("symbol", "ts", "close")
    first, rest = bars.where("ts < '2024-01-15'"), bars.where("ts >= '2024-01-15'")
    scans = V.Scans(spark, f"{S.work_dir(spark)}/scans")
    pinned = scans.replace(scans.tables.pin(), first, first.where("close < 6"), "r1")
    found = scans.results(pinned).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_found"))
    scans.compact(scans.replace(pinned, rest, rest.where("close < 6"), "r1"))
    return scans.marks("r1", pinned).join(found, "symbol", "left").select("symbol", F.coalesce("n_found", F.lit(0)).alias("n_found"), "through")


@query("o914_failures_apart", "SELECT symbol, n, CASE WHEN symbol = 'error' THEN 'ValueError: bad symbol' END AS error FROM (SELECT event_type AS symbol, CASE WHEN event_type <> 'error' THEN count(*) END AS n FROM events GROUP BY 1)")
def o914(spark, d):
    def step(pdf):
        if pdf["symbol"].iat[0] == "error":
            raise ValueError("bad symbol")
        return pdf.groupby("symbol", as_index=False).agg(n=("n", "sum"))

    hourly = K.bars_1h(spark, d).select("symbol", F.col("volume").alias("n"))
    return S.each_key_apart(hourly, "symbol", step, "symbol string, n long")
