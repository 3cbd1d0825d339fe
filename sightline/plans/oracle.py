"""DuckDB SQL for each registered query (the correctness oracle).

Written independently of the Spark plans: bit strings are built with list
lambdas, hex digits nibble by nibble, distances with ``hamming``.  Sums are
sequential folds (``list_reduce``) in the same order as the Spark side so
the doubles compared against a mean or median are the same.
"""

from __future__ import annotations


GRID = ("SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS g, "
        "(len(embedding) * 4)::BIGINT AS file_size FROM embeddings")


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN '1' ELSE '0' END"


def hex_of(bits: str, n_bits: int) -> str:
    """SQL: bit string of ``n_bits`` chars -> lower-case hex, ceil(n/4) digits."""
    nd = (n_bits + 3) // 4
    p = f"lpad({bits}, {4 * nd}, '0')"
    nib = " + ".join(f"{w} * (substr({p}, 4 * i + {j + 1}, 1) = '1')::INT"
                     for j, w in enumerate((8, 4, 2, 1)))
    return (f"array_to_string(list_transform(range(0, {nd}), "
            f"lambda i: substr('0123456789abcdef', 1 + {nib}, 1)), '')")


def _sum(lst: str) -> str:
    return f"list_reduce({lst}, lambda a, b: a + b)"


def _median_sorted(lst: str, n: int) -> str:
    s = f"list_sort({lst})"
    if n % 2:
        return f"{s}[{n // 2 + 1}]"
    return f"(({s}[{n // 2}] + {s}[{n // 2 + 1}]) / 2.0)"


def average_bits(k: int = 8) -> str:
    """CTE body: vec_id, label, file_size, bs (average hash bit string)."""
    return (f"SELECT vec_id, label, file_size, array_to_string(list_transform(g, "
            f"lambda x: {_flag('x > m')}), '') AS bs FROM "
            f"(SELECT *, {_sum('g')} / {float(k * k)} AS m FROM ({GRID}))")


def difference_bits(k: int = 7, w: int = 8) -> str:
    cond = f"g[(b // {k}) * {w} + b % {k} + 2] > g[(b // {k}) * {w} + b % {k} + 1]"
    return (f"SELECT vec_id, label, file_size, array_to_string(list_transform(range(0, {k * k}), "
            f"lambda b: {_flag(cond)}), '') AS bs FROM ({GRID})")


def wavelet_bits(k: int = 4, n: int = 8) -> str:
    b = n // k
    cell = f"g[((q // {k}) * {b} + t // {b}) * {n} + (q % {k}) * {b} + t % {b} + 1]"
    blocks = f"list_transform(range(0, {k * k}), lambda q: {_sum(f'list_transform(range(0, {b * b}), lambda t: {cell})')})"
    med = _median_sorted("s", k * k)
    return (f"SELECT vec_id, label, file_size, array_to_string(list_transform(s, "
            f"lambda x: {_flag(f'x > {med}')}), '') AS bs FROM "
            f"(SELECT *, {blocks} AS s FROM ({GRID}))")


def perceptual_bits(k: int = 4, n: int = 8) -> str:
    def basis(u: str, i: str) -> str:
        return f"cos(pi() * ({u}) * (2 * ({i}) + 1) / {2 * n})"
    t_cell = _sum(f"list_transform(range(0, {n}), lambda i: {basis(f'q // {n}', 'i')} * g[i * {n} + q % {n} + 1])")
    t = f"list_transform(range(0, {k * n}), lambda q: {t_cell})"
    coef = _sum(f"list_transform(range(0, {n}), lambda j: t[(b // {k}) * {n} + j + 1] * {basis(f'b % {k}', 'j')})")
    coefs = f"list_transform(range(0, {k * k}), lambda b: {coef})"
    med = _median_sorted("c", k * k)
    return (f"SELECT vec_id, label, file_size, array_to_string(list_transform(c, "
            f"lambda x: {_flag(f'x > {med}')}), '') AS bs FROM "
            f"(SELECT *, {coefs} AS c FROM (SELECT *, {t} AS t FROM ({GRID})))")


BITS = {"average": (average_bits, 8), "difference": (difference_bits, 7),
        "perceptual": (perceptual_bits, 4), "wavelet": (wavelet_bits, 4)}


def hash_query(algorithm: str) -> str:
    fn, k = BITS[algorithm]
    n = k * k
    return (f"WITH s AS ({fn()}) SELECT vec_id, '{algorithm}' AS algorithm, {k} AS hash_size, "
            f"{n} AS n_bits, {hex_of('bs', n)} AS hash_hex FROM s")


def _similarity(dist: str, n: int) -> str:
    return f"greatest(0.0::DOUBLE, (1.0::DOUBLE - ({dist})::DOUBLE / {float(n)}) * 100.0::DOUBLE)"


def _human(x: str) -> str:
    v = f"({x})::DOUBLE"
    return (f"CASE WHEN {v} < 1024 THEN ({v})::BIGINT::VARCHAR || ' B' "
            f"WHEN {v} / 1024 < 1024 THEN printf('%.1f KB', {v} / 1024) "
            f"WHEN {v} / 1024 / 1024 < 1024 THEN printf('%.1f MB', {v} / 1024 / 1024) "
            f"WHEN {v} / 1024 / 1024 / 1024 < 1024 THEN printf('%.1f GB', {v} / 1024 / 1024 / 1024) "
            f"ELSE printf('%.1f TB', {v} / 1024 / 1024 / 1024 / 1024) END")


def search_matches(threshold: float = 60.0) -> str:
    """reference, candidate, distance, similarity_pct, file_size vs vec 0."""
    return (f"WITH s AS ({average_bits()}), r AS (SELECT bs FROM s WHERE vec_id = 0) "
            f"SELECT 0::BIGINT AS reference, s.vec_id AS candidate, hamming(s.bs, r.bs)::INTEGER AS distance, "
            f"{_similarity('hamming(s.bs, r.bs)', 64)} AS similarity_pct, s.file_size "
            f"FROM s, r WHERE s.vec_id <> 0 AND {_similarity('hamming(s.bs, r.bs)', 64)} >= {threshold}::DOUBLE")


def ranked_matches(threshold: float = 60.0) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY similarity_pct DESC, candidate ASC) AS rank "
            f"FROM ({search_matches(threshold)})")


def _lanczos_sql(x: str) -> str:
    def sinc(v: str) -> str:
        return f"(CASE WHEN ({v}) = 0 THEN 1.0 ELSE sin(({v}) * pi()) / (({v}) * pi()) END)"
    return f"(CASE WHEN ({x}) >= -3.0 AND ({x}) < 3.0 THEN {sinc(x)} * {sinc(f'({x}) / 3')} ELSE 0.0 END)"


def resample_weights_sql(n_in: int, n_out: int) -> str:
    """Rows (o, t, w): 8-bit fixed-point Lanczos-3 weights (22 bits) from
    output position o to input position t, computed in SQL."""
    scale = n_in / n_out
    fs = max(scale, 1.0)
    support = 3.0 * fs
    raw = (f"SELECT o, t, {_lanczos_sql(f'(t - ((o + 0.5) * {scale}) + 0.5) * {1.0 / fs}')} AS k "
           f"FROM range(0, {n_out}) a(o), range(0, {n_in}) b(t) "
           f"WHERE t >= greatest(trunc((o + 0.5) * {scale} - {support} + 0.5), 0) "
           f"AND t < least(trunc((o + 0.5) * {scale} + {support} + 0.5), {n_in})")
    norm = f"SELECT o, t, k / sum(k) OVER (PARTITION BY o) AS k FROM ({raw})"
    return (f"SELECT o, t, (CASE WHEN k < 0 THEN trunc(-0.5 + k * 4194304.0) "
            f"ELSE trunc(0.5 + k * 4194304.0) END)::BIGINT AS w FROM ({norm})")


PIXELS = ("SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, "
          "CASE WHEN hi > lo THEN round((v[i] - lo) / (hi - lo) * 255.0)::BIGINT ELSE 0 END AS p "
          "FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, "
          "list_min(list_transform(embedding, lambda x: x::DOUBLE)) AS lo, "
          "list_max(list_transform(embedding, lambda x: x::DOUBLE)) AS hi FROM embeddings), "
          "range(1, 65) t(i)")


def decode_images_sql() -> str:
    return ("SELECT vec_id, 8 AS height, 8 AS width, 1 AS n_channels, "
            "string_agg(printf('%02X', p), '' ORDER BY r, c) AS pixels_hex "
            f"FROM ({PIXELS}) GROUP BY vec_id")


def luminance_grid_sql() -> str:
    """8 x 8 one-channel pictures from embeddings, resized to 4 x 4 (rows,
    then columns, rounding to 8 bits after each pass), average hash."""
    pix = PIXELS
    clip = "greatest(0, least(255, (sum({a} * w) + 2097152) >> 22))"
    horiz = (f"SELECT vec_id, r, o AS c, {clip.format(a='p')} AS p FROM ({pix}) x "
             f"JOIN ({resample_weights_sql(8, 4)}) k ON k.t = x.c GROUP BY vec_id, r, o")
    vert = (f"SELECT vec_id, o AS r, c, {clip.format(a='p')}::DOUBLE AS p FROM ({horiz}) x "
            f"JOIN ({resample_weights_sql(8, 4)}) k ON k.t = x.r GROUP BY vec_id, o, c")
    grid = f"SELECT vec_id, list(p ORDER BY r, c) AS g FROM ({vert}) GROUP BY vec_id"
    bits = (f"SELECT vec_id, g, array_to_string(list_transform(g, lambda x: {_flag('x > m')}), '') AS bs "
            f"FROM (SELECT *, {_sum('g')} / 16.0 AS m FROM ({grid}))")
    return (f"SELECT vec_id, array_to_string(list_transform(g, lambda x: x::INTEGER::VARCHAR), ',') AS grid, "
            f"{hex_of('bs', 16)} AS hash_hex FROM ({bits})")


COLOUR_PIXELS = ("SELECT vec_id, r, c, (19595 * (255 - p) + 38470 * ((p * 3) % 256) + 7471 * p + 32768) >> 16 AS p "
                 f"FROM ({PIXELS}) WHERE vec_id % 10 <> 3")


INVERTED_PIXELS = f"SELECT vec_id, r, c, CASE WHEN vec_id % 10 = 0 THEN 255 - p ELSE p END AS p FROM ({PIXELS})"


def resized_sql(n_out: int, pixels: str = PIXELS) -> str:
    """vec_id, g: 8 x 8 pictures resized to ``n_out`` squared, row-major."""
    clip = "greatest(0, least(255, (sum({a} * w) + 2097152) >> 22))"
    if n_out == 8:
        return f"SELECT vec_id, list(p::DOUBLE ORDER BY r, c) AS g FROM ({pixels}) GROUP BY vec_id"
    horiz = (f"SELECT vec_id, r, o AS c, {clip.format(a='p')} AS p FROM ({pixels}) x "
             f"JOIN ({resample_weights_sql(8, n_out)}) k ON k.t = x.c GROUP BY vec_id, r, o")
    vert = (f"SELECT vec_id, o AS r, c, {clip.format(a='p')}::DOUBLE AS p FROM ({horiz}) x "
            f"JOIN ({resample_weights_sql(8, n_out)}) k ON k.t = x.r GROUP BY vec_id, o, c")
    return f"SELECT vec_id, list(p ORDER BY r, c) AS g FROM ({vert}) GROUP BY vec_id"


def picture_average_bits(k: int, pixels: str = PIXELS) -> str:
    return (f"SELECT vec_id, array_to_string(list_transform(g, lambda x: {_flag('x > m')}), '') AS bs "
            f"FROM (SELECT *, {_sum('g')} / {float(k * k)} AS m FROM ({resized_sql(k, pixels)}))")


def picture_median_bits(values: str, n: int) -> str:
    """Bits of values (vec_id, s) above their median."""
    return (f"SELECT vec_id, array_to_string(list_transform(s, lambda x: {_flag(f'x > m')}), '') AS bs FROM "
            f"(SELECT *, {_median_sorted('s', n)} AS m FROM ({values}))")


def picture_perceptual_bits(k: int = 8) -> str:
    """Low k x k block of the DCT-II of the 4k x 4k picture, as joins."""
    n = 4 * k
    basis = (f"SELECT u, i, cos(pi() * u * (2 * i + 1) / {2 * n}) AS b FROM range(0, {k}) a(u), range(0, {n}) c(i)")
    cells = (f"SELECT vec_id, (q - 1) // {n} AS i, (q - 1) % {n} AS j, g[q] AS p "
             f"FROM ({resized_sql(n)}), range(1, {n * n + 1}) t(q)")
    rows = f"SELECT vec_id, u, j, sum(p * b) AS p FROM ({cells}) x JOIN ({basis}) y USING (i) GROUP BY vec_id, u, j"
    coef = (f"SELECT vec_id, x.u AS u, y.u AS v, sum(p * b) AS p FROM ({rows}) x "
            f"JOIN ({basis}) y ON y.i = x.j GROUP BY vec_id, x.u, y.u")
    return picture_median_bits(f"SELECT vec_id, list(p ORDER BY u, v) AS s FROM ({coef}) GROUP BY vec_id", k * k)


def picture_wavelet_bits(k: int = 4) -> str:
    b = 8 // k
    blocks = (f"SELECT vec_id, r // {b} AS i, c // {b} AS j, sum(p)::DOUBLE AS p FROM ({PIXELS}) "
              f"GROUP BY vec_id, r // {b}, c // {b}")
    return picture_median_bits(f"SELECT vec_id, list(p ORDER BY i, j) AS s FROM ({blocks}) GROUP BY vec_id", k * k)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_images"] = (
        "SELECT page_id, file_uri, lower(regexp_extract(file_uri, '[^/](\\.[^./]+)$', 1)) AS extension "
        "FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS file_uri FROM pages) "
        "WHERE lower(regexp_extract(file_uri, '[^/](\\.[^./]+)$', 1)) IN ('.html')")
    q["file_inventory"] = (
        "SELECT source AS root, source || '/' || doc_id::VARCHAR AS file_uri, n_chars::BIGINT AS size "
        "FROM documents")
    q["exclude_self"] = (
        "SELECT source || '/' || doc_id::VARCHAR AS file_uri, n_chars::BIGINT AS size FROM documents "
        "WHERE source || '/' || doc_id::VARCHAR <> (SELECT source || '/' || doc_id::VARCHAR "
        "FROM documents WHERE doc_id = 0)")
    q["size_prefilter"] = (
        "WITH r AS (SELECT source || '/' || doc_id::VARCHAR AS uri, n_chars::DOUBLE AS s FROM documents "
        "WHERE doc_id = 0) "
        "SELECT source || '/' || doc_id::VARCHAR AS file_uri, n_chars::BIGINT AS size FROM documents, r "
        "WHERE source || '/' || doc_id::VARCHAR <> r.uri "
        "AND n_chars BETWEEN trunc(r.s * 0.5)::BIGINT AND trunc(r.s * 1.5)::BIGINT")
    for alg in BITS:
        q[f"hash_{alg}"] = hash_query(alg)
    q["hash_hex_roundtrip"] = (
        f"WITH s AS ({average_bits()}) SELECT vec_id, {hex_of('bs', 64)} AS hash_hex, "
        f"{hex_of('bs', 64)} AS roundtrip_hex, bs::BIT::BIGINT AS word0 FROM s")
    q["hamming_distance"] = (
        f"WITH s AS ({average_bits()}), r AS (SELECT bs FROM s WHERE vec_id = 0) "
        f"SELECT s.vec_id, hamming(s.bs, r.bs)::INTEGER AS distance FROM s, r")
    q["similarity_pct"] = (
        f"WITH s AS ({difference_bits()}), r AS (SELECT bs FROM s WHERE vec_id = 0) "
        f"SELECT s.vec_id, hamming(s.bs, r.bs)::INTEGER AS distance, "
        f"{_similarity('hamming(s.bs, r.bs)', 49)} AS similarity_pct FROM s, r")
    q["similarity_search"] = ranked_matches()
    q["match_report"] = (
        "SELECT rank, '  [' || rank::VARCHAR || ']   ✓ ' || candidate::VARCHAR || chr(10) || "
        "'    Similarity: ' || printf('%.1f', similarity_pct) || '% | Hamming distance: ' || "
        f"distance::VARCHAR || ' | Size: ' || {_human('file_size')} AS line FROM ({ranked_matches()})")
    q["json_report"] = (
        "SELECT rank, to_json({'reference': reference, 'candidate': candidate, "
        "'similarity_pct': similarity_pct, 'distance': distance, 'file_size': file_size})::VARCHAR AS json "
        f"FROM ({ranked_matches()})")
    q["batch_search"] = (
        f"WITH s AS ({average_bits()}), refs AS (SELECT s.* FROM s JOIN "
        f"(SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) m USING (vec_id)), "
        f"p AS (SELECT r.vec_id AS reference, c.vec_id AS candidate, hamming(r.bs, c.bs)::INTEGER AS distance, "
        f"{_similarity('hamming(r.bs, c.bs)', 64)} AS similarity_pct, c.file_size "
        f"FROM refs r JOIN s c ON r.vec_id <> c.vec_id AND {_similarity('hamming(r.bs, c.bs)', 64)} >= 60.0::DOUBLE "
        f"AND c.file_size BETWEEN trunc(r.file_size * 0.5)::BIGINT AND trunc(r.file_size * 1.5)::BIGINT) "
        f"SELECT *, row_number() OVER (PARTITION BY reference ORDER BY similarity_pct DESC, candidate) AS rank "
        f"FROM p")
    split = "(SELECT max(event_id) // 2 FROM events)"
    ev = "SELECT user_id, event_type, event_id, value AS size, ts AS mtime FROM events"
    latest = ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type "
              "ORDER BY event_id DESC) AS rn FROM ({src})) WHERE rn = 1")
    stored = latest.format(src=f"{ev} WHERE event_id < {split}")
    current = latest.format(src=ev)
    q["signature_upsert"] = (
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type "
        "ORDER BY seq DESC, event_id DESC) AS rn FROM ("
        f"SELECT *, 0 AS seq FROM ({stored}) UNION ALL "
        f"SELECT *, 1 AS seq FROM ({latest.format(src=f'{ev} WHERE event_id >= {split}')}))) "
        "WHERE rn = 1")
    q["signature_upsert"] = f"SELECT user_id, event_type, event_id, size, mtime FROM ({q['signature_upsert']})"
    q["signature_lookup"] = (
        f"SELECT c.user_id, c.event_type, c.size, c.mtime, CASE WHEN s.size IS NULL AND s.mtime IS NULL "
        f"THEN 'miss' WHEN s.size = c.size AND s.mtime = c.mtime THEN 'hit' ELSE 'stale' END AS status "
        f"FROM ({current}) c LEFT JOIN ({stored}) s USING (user_id, event_type)")
    q["signature_misses"] = (
        f"SELECT c.user_id, c.event_type, c.size, c.mtime FROM ({current}) c WHERE NOT EXISTS "
        f"(SELECT 1 FROM ({stored}) s WHERE s.user_id = c.user_id AND s.event_type = c.event_type "
        f"AND s.size = c.size AND s.mtime = c.mtime)")
    q["merge_results"] = (
        f"SELECT c.user_id, c.event_type, c.size, c.mtime, "
        f"CASE WHEN s.user_id IS NOT NULL THEN 'store' ELSE 'fresh' END AS origin "
        f"FROM ({current}) c LEFT JOIN ({stored}) s ON s.user_id = c.user_id "
        f"AND s.event_type = c.event_type AND s.size = c.size AND s.mtime = c.mtime")
    q["inventory_replace"] = (
        "SELECT source AS root, count(*)::BIGINT AS file_count, sum(n_chars)::BIGINT AS total_size "
        "FROM documents GROUP BY source")
    q["inventory_staleness"] = (
        "WITH cur AS (SELECT source AS root, count(*)::BIGINT AS stored_rows FROM documents GROUP BY source), "
        "meta AS (SELECT source AS root, count(DISTINCT text)::BIGINT AS file_count FROM documents "
        "GROUP BY source) "
        "SELECT cur.root, cur.stored_rows, meta.file_count, "
        "(meta.file_count IS NOT NULL AND cur.stored_rows > 0 AND cur.stored_rows = meta.file_count) AS fresh "
        "FROM cur LEFT JOIN meta USING (root)")
    q["search_stats"] = (
        f"WITH s AS ({average_bits()}), r AS (SELECT bs FROM s WHERE vec_id = 0), "
        f"o AS (SELECT s.vec_id, l.doc_id IS NOT NULL AS ok, {_similarity('hamming(s.bs, r.bs)', 64)} >= 60.0::DOUBLE AS matched "
        f"FROM s CROSS JOIN r LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = s.vec_id "
        f"WHERE s.vec_id <> 0) "
        f"SELECT count(*)::BIGINT AS total_files, count(*) FILTER (WHERE ok)::BIGINT AS images_scanned, "
        f"count(*) FILTER (WHERE NOT ok)::BIGINT AS images_failed, "
        f"count(*) FILTER (WHERE ok AND matched)::BIGINT AS matches_found, 1.5::DOUBLE AS elapsed_seconds, "
        f"round_even(count(*) FILTER (WHERE ok) / 1.5::DOUBLE, 0) AS speed_img_s FROM o")
    q["human_size"] = (
        "SELECT doc_id, e AS scale_exp, (n_chars * pow(1024, e))::BIGINT AS size, "
        f"{_human('n_chars * pow(1024, e)')} AS human FROM documents, range(0, 5) t(e)")
    q["decode_images"] = decode_images_sql()
    q["luminance_grid"] = luminance_grid_sql()
    q["folder_listing"] = "SELECT vec_id, '.png' AS extension, true AS has_bytes FROM embeddings"

    def hashes(bits: str, n: int) -> str:
        return (f"SELECT e.vec_id, {hex_of('bs', n)} AS hash_hex FROM embeddings e "
                f"LEFT JOIN ({bits}) s ON s.vec_id = e.vec_id")

    q["picture_average_256"] = hashes(picture_average_bits(16), 256)
    q["picture_perceptual"] = hashes(picture_perceptual_bits(8), 64)
    q["picture_wavelet"] = hashes(picture_wavelet_bits(4), 16)
    q["picture_colour"] = hashes(picture_average_bits(4, COLOUR_PIXELS), 16)
    q["picture_perceptual_256"] = hashes(picture_perceptual_bits(16), 256)
    q["refresh_listing"] = hashes(picture_average_bits(8, INVERTED_PIXELS), 64)
    wide = picture_average_bits(16)
    far = _similarity("hamming(a.bs, b.bs)", 256)
    q["picture_search_256"] = (
        f"WITH s AS MATERIALIZED ({wide}) SELECT b.vec_id, hamming(a.bs, b.bs)::INTEGER AS distance, "
        f"{far} AS similarity_pct FROM s a, s b WHERE a.vec_id = 0 AND b.vec_id <> 0 AND {far} >= 60.0::DOUBLE")
    pairs = (
        f"WITH s AS MATERIALIZED ({wide}) SELECT a.vec_id AS reference, b.vec_id AS candidate, "
        f"hamming(a.bs, b.bs)::INTEGER AS distance, {far} AS similarity_pct FROM s a, s b "
        f"WHERE a.vec_id <> b.vec_id AND {far} >= 65.0::DOUBLE")
    q["batch_search_banded"] = q["batch_search_chunked"] = q["batch_search_metric"] = pairs
    planted = (
        f"WITH s AS ({wide}), p AS MATERIALIZED (SELECT s.vec_id * 5 + c AS id, 256 + (s.vec_id % 97) * 16 * (c + 1) AS file_size, "
        # 173 * 37 = 1 mod 256: the k-th flipped place of copy c is vec_id * 7 + k * 37 + c * 11
        "array_to_string(list_transform(range(256), lambda i: CASE "
        "WHEN (((i - s.vec_id * 7 - c * 11) * 173) % 256 + 256) % 256 < 6 * c "
        "THEN translate(substr(bs, i::INTEGER + 1, 1), '01', '10') ELSE substr(bs, i::INTEGER + 1, 1) END), '') AS bs "
        "FROM s, range(5) r(c)) SELECT a.id AS reference, b.id AS candidate, hamming(a.bs, b.bs)::INTEGER AS distance, "
        f"{far} AS similarity_pct{{more}} FROM p a, p b WHERE a.id <> b.id AND {far} >= 90.0::DOUBLE")
    q["batch_search_windowed"] = planted.format(more=", b.file_size") + (
        " AND b.file_size BETWEEN trunc(a.file_size * 0.5)::BIGINT AND trunc(a.file_size * 1.5)::BIGINT")
    q["tree_listing"] = (
        "SELECT vec_id, label, '' AS hundred, (vec_id // 100)::INTEGER AS encoded_hundred, vec_id % 7 = 6 AS hidden, "
        "true AS has_bytes FROM embeddings")
    q["store_roundtrip"] = q["store_by_key"] = (
        "SELECT user_id::VARCHAR || '/' || event_type AS file_uri, event_id AS size, mtime, "
        f"printf('%016x', event_id) AS hash_hex FROM ({current})")
    q["inventory_roundtrip"] = (
        "WITH f AS (SELECT source AS root, doc_id, regexp_extract(source, '([0-9]+)$', 1)::INTEGER % 2 = 0 AS even "
        "FROM documents) SELECT root, count(*) FILTER (WHERE NOT even OR doc_id % 2 = 0)::BIGINT AS stored_rows, "
        "count(*) FILTER (WHERE NOT even OR doc_id % 2 = 0)::BIGINT AS file_count, bool_and(even) AS fresh "
        "FROM f GROUP BY root")
    q["stream_refresh"] = (
        f"WITH s AS ({average_bits()}) SELECT vec_id, {hex_of('bs', 64)} AS hash_hex FROM s")
    return q
