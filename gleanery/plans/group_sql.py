"""SQL of the grouping chain for DuckDB, as CTEs that follow ``views.SQL``."""

from __future__ import annotations


def fnv(seed: str) -> str:
    """FNV-1a, 64 bits, of an ASCII string expression, as 16 hex digits."""
    octets = f"list_transform(string_split({seed}, ''), lambda c: ascii(c)::HUGEINT)"
    return f"lpad(lower(to_hex((list_reduce(list_prepend(14695981039346656037::HUGEINT, {octets}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))::UBIGINT)), 16, '0')"


STAGES = """
, d1 AS (SELECT *, media_type = 'image' AND original_hash IS NOT NULL AND count(*) OVER (PARTITION BY library_id,
    CASE WHEN media_type = 'image' AND original_hash IS NOT NULL THEN 'h' || original_hash ELSE 'k' || key END) > 1 AS is_dup FROM soft)
, d2 AS (SELECT *, NOT is_dup AND (is_screenshot OR is_screen_recording) AS is_util FROM d1)
, bs AS (SELECT library_id, burst_identifier, count(*) AS n, count(bias) AS nb, count(DISTINCT round(bias * 10)) AS nd, max(bias) - min(bias) AS sp FROM d2
    WHERE NOT is_dup AND NOT is_util AND media_type = 'image' AND burst_identifier IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
, d3 AS (SELECT d2.*, CASE WHEN is_dup THEN 'exactDuplicate' WHEN is_util THEN 'expiredUtility' WHEN media_type = 'image' AND bs.n IS NOT NULL
    THEN CASE WHEN nb = n AND n BETWEEN 2 AND 7 AND nd = n AND sp >= 0.5 THEN 'bracket' ELSE 'burst' END END AS k1 FROM d2 LEFT JOIN bs USING (library_id, burst_identifier))
, sess0 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY library_id ORDER BY us, key) > 14400000000 THEN 1 ELSE 0 END AS st FROM d3 WHERE k1 IS NULL AND media_type = 'image' AND us IS NOT NULL)
, sess AS (SELECT *, sum(st) OVER (PARTITION BY library_id ORDER BY us, key) AS sid FROM sess0)
, runs0 AS (SELECT *, round(bias * 10) AS b10, lag(round(bias * 10)) OVER w AS p10, us - lag(us) OVER w AS dgap FROM sess WINDOW w AS (PARTITION BY library_id, sid ORDER BY us, key))
, runs1 AS (SELECT *, sum(CASE WHEN b10 IS NULL OR p10 IS NULL OR dgap > 1800000000 OR b10 = p10 THEN 1 ELSE 0 END) OVER (PARTITION BY library_id, sid ORDER BY us, key) AS island FROM runs0)
, runs AS (SELECT *, (row_number() OVER (PARTITION BY library_id, sid, island ORDER BY us, key) - 1) // 7 AS chunk FROM runs1 WHERE b10 IS NOT NULL)
, goodruns AS (SELECT library_id, sid, island, chunk FROM runs GROUP BY ALL HAVING count(*) BETWEEN 2 AND 7 AND count(DISTINCT b10) = count(*) AND max(bias) - min(bias) >= 0.5)
, br AS (SELECT library_id, key, 'run:' || sid::VARCHAR || ':' || island::VARCHAR || ':' || chunk::VARCHAR AS rseed FROM runs JOIN goodruns USING (library_id, sid, island, chunk))
, op AS (SELECT * FROM sess WHERE vector IS NOT NULL AND key NOT IN (SELECT key FROM br))
, prs AS (SELECT a.library_id, a.key AS ka, b.key AS kb, b.us - a.us AS gap, a.vector AS va, b.vector AS vb FROM op a JOIN op b ON a.library_id = b.library_id AND a.sid = b.sid
    AND b.us - a.us BETWEEN 0 AND 3600000000 AND (b.us > a.us OR a.key < b.key))
, edg0 AS (SELECT *, CASE WHEN gap < 3000000 THEN 1.35 WHEN gap < 120000000 THEN 1.30 WHEN gap < 3600000000 THEN 1.20 END::DOUBLE AS lim, list_distance(va, vb) AS dist FROM prs)
, edg AS (SELECT library_id, ka, kb, gap, dist, (lim - dist) / lim AS margin FROM edg0 WHERE dist <= lim)
, sym AS (SELECT ka AS a, kb AS b FROM edg UNION SELECT kb, ka FROM edg)
, reach(n, r) AS (SELECT DISTINCT a, a FROM sym UNION SELECT reach.n, sym.b FROM reach JOIN sym ON sym.a = reach.r)
, comp AS (SELECT n AS key, min(r) AS c FROM reach GROUP BY n)
, marg AS (SELECT c, max(margin) AS margin FROM edg JOIN comp ON comp.key = edg.ka GROUP BY c)
, fin0 AS (SELECT d3.*, br.rseed, comp.c, marg.margin, bool_or(is_edited) OVER (PARTITION BY coalesce(comp.c, d3.key)) AS any_edit
    FROM d3 LEFT JOIN br USING (library_id, key) LEFT JOIN comp USING (key) LEFT JOIN marg USING (c))
, fin AS (SELECT *, CASE WHEN k1 IS NOT NULL THEN k1 WHEN rseed IS NOT NULL THEN 'bracket' WHEN c IS NOT NULL THEN CASE WHEN any_edit THEN 'versions' ELSE 'nearDuplicate' END
      WHEN media_type = 'image' AND tier = 'obviouslyBroken' THEN 'failedFrame' END AS kind,
    CASE WHEN k1 = 'exactDuplicate' THEN original_hash WHEN k1 = 'expiredUtility' THEN coalesce(year(make_timestamp(us))::VARCHAR, 'no date') WHEN k1 IS NOT NULL THEN 'burst:' || burst_identifier ELSE coalesce(rseed, c, key) END AS seed FROM fin0)
, mem AS (SELECT *, coalesce(us, 4611686018427387904) AS o FROM fin WHERE kind IS NOT NULL)
, agg AS (SELECT library_id, kind, seed, list(key ORDER BY o, key) AS ks, count(*) AS n, count(*) FILTER (is_soft) AS soft, min(raw_us) AS oldest, min(us) AS lo_us, max(us) AS hi_us, max(margin) AS margin,
    list(key ORDER BY o, key) FILTER (proposable AND CASE kind WHEN 'expiredUtility' THEN coalesce(us < 1707955200000000 - 2592000000000, true) WHEN 'versions' THEN NOT is_edited ELSE kind IN ('exactDuplicate', 'failedFrame') END) AS mf,
    coalesce(first(key ORDER BY o, key) FILTER (NOT deletable), first(key ORDER BY o, key) FILTER (is_favorite), first(key ORDER BY o, key)) AS dk,
    coalesce(first(key ORDER BY o, key) FILTER (user_pick), first(key ORDER BY o, key) FILTER (auto_pick)) AS bk,
    coalesce(first(key ORDER BY o, key) FILTER (is_edited AND is_favorite), first(key ORDER BY modified_us DESC, o, key) FILTER (is_edited)) AS ek, first(reasons[1]) AS reason FROM mem GROUP BY ALL)
, grp0 AS (SELECT *, CASE kind WHEN 'exactDuplicate' THEN dk WHEN 'burst' THEN bk WHEN 'versions' THEN ek END AS keeper, (1707955200000000 - coalesce(oldest, 1707955200000000)) / 1000000.0::DOUBLE AS age FROM agg)
, grp AS (SELECT *, CASE WHEN kind = 'exactDuplicate' THEN list_filter(coalesce(mf, []), lambda x: x <> keeper) ELSE coalesce(mf, []) END AS fl,
    CASE kind WHEN 'exactDuplicate' THEN 0.95 WHEN 'expiredUtility' THEN least(0.9, 0.5 + 0.4 * least(age / 15552000, 1)) WHEN 'burst' THEN CASE WHEN soft = 0 THEN 0.55 ELSE least(0.87, 0.72 + 0.15 * soft / n) END
      WHEN 'bracket' THEN 0.1 WHEN 'nearDuplicate' THEN 0.3 + 0.2 * coalesce(margin, 0) WHEN 'versions' THEN 0.8 ELSE 1.0 END::DOUBLE AS certainty,
    CASE kind WHEN 'failedFrame' THEN 0 WHEN 'exactDuplicate' THEN 1 WHEN 'burst' THEN 2 WHEN 'expiredUtility' THEN 3 WHEN 'nearDuplicate' THEN 4 ELSE 5 END AS rank,
    """ + fnv("kind || '|' || array_to_string(list_sort(ks), '|')") + """ AS group_id,
    CASE WHEN soft > 0 THEN ', ' || soft || ' may be soft' ELSE '' END AS maybe FROM grp0)
, groups AS (SELECT library_id, group_id, kind, ks, array_to_string(ks, '|') AS members, coalesce(keeper, ks[1]) AS representative, CASE WHEN hi_us > lo_us AND kind <> 'failedFrame' THEN lo_us // 1000000 END AS span_start,
    CASE WHEN hi_us > lo_us AND kind <> 'failedFrame' THEN hi_us // 1000000 END AS span_end, round(certainty, 6) AS certainty, fl, array_to_string(fl, '|') AS flagged, keeper,
    CASE kind WHEN 'exactDuplicate' THEN n || ' copies of one photo' WHEN 'expiredUtility' THEN n || CASE WHEN n = 1 THEN ' screen capture, ' ELSE ' screen captures, ' END || seed WHEN 'burst' THEN 'Burst of ' || n || maybe
      WHEN 'bracket' THEN 'Bracket of ' || n || ', keep all' WHEN 'nearDuplicate' THEN n || ' near-identical shots' || maybe
      WHEN 'versions' THEN CASE WHEN len(fl) > 0 THEN 'Edited version, the original can go' ELSE 'Original and edited version' END ELSE coalesce(reason, 'Not a photograph') END AS headline,
    row_number() OVER (PARTITION BY library_id ORDER BY rank, certainty DESC, group_id) AS position FROM grp)
"""
