"""DuckDB SQL that gives the same rows as each query, built from shared steps."""

from __future__ import annotations



def _signs(count: int) -> str:
    """Signs of the projections from the public recipe (xorshift64*, its lowest bit), written anew here as the other side of a check."""
    state, out = 0xD1B54A32D192ED03, []
    for _ in range(count):
        state = state ^ (state >> 12)
        state = (state ^ (state << 25)) % 2**64
        state = state ^ (state >> 27)
        out.append(str((state * 0x2545F4914F6CDD1D) % 2))
    return "".join(out)


_SIGNS = _signs(12 * 16 * 64)
_PASS = """CASE WHEN coalesce({q}.width, 0) <= 0 OR coalesce({q}.height, 0) <= 0 OR coalesce({c}.width, 0) <= 0 OR coalesce({c}.height, 0) <= 0 THEN true
 WHEN greatest(({q}.width::DOUBLE / {q}.height) / ({c}.width::DOUBLE / {c}.height), ({c}.width::DOUBLE / {c}.height) / ({q}.width::DOUBLE / {q}.height)) > 1.2::DOUBLE THEN false
 WHEN coalesce({q}.file_size, 0) > 0 AND coalesce({c}.file_size, 0) > 0 AND greatest({q}.file_size, {c}.file_size) > least({q}.file_size, {c}.file_size) * 10 THEN false ELSE true END"""
PASS = _PASS.format(q="q", c="c")

#: Of every document 72 counts of its distinct words, by the first 16 bits of their MD5, and the bits that these make.
GRIDS = """
binned AS (SELECT doc_id, text, list_transform(list_distinct(string_split(text, ' ')), lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 72) AS bins FROM documents),
grids AS (SELECT doc_id, text, list_transform(range(0, 72), lambda k: len(list_filter(bins, lambda b: b = k))) AS l FROM binned),
wide AS (SELECT *, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN l[(i // 8) * 9 + i % 8 + 1] > l[(i // 8) * 9 + i % 8 + 2] THEN (1::HUGEINT << i::INT) ELSE 0::HUGEINT END))::HUGEINT AS u FROM grids)"""
#: The low byte of every character.
CODES = """
coded AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN [0] ELSE list_transform(string_split(text, ''), lambda c: (unicode(c) & 255)::INT) END AS codes FROM documents)"""
DOCS = (
    GRIDS
    + """,
docs AS (SELECT doc_id AS ord, 'd' || doc_id AS id, sha256(text) AS content_hash, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS h,
  length(text)::INT AS width, len(string_split(text, chr(10)))::INT AS height, strlen(text)::BIGINT AS file_size, e.embedding
  FROM wide LEFT JOIN embeddings e ON e.vec_id = doc_id)"""
)
REPS = DOCS + ", reps AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY ord) = 1)"


def _blocks(r: int) -> str:
    width = 64 // (r + 1)
    cut = " UNION ALL ".join(f"SELECT ord, u, {b} AS block, ((u >> {b * width}) & {(1 << (width if b < r else 64 - b * width)) - 1})::BIGINT AS key FROM hashed" for b in range(r + 1))
    return f", hashed AS (SELECT ord, CASE WHEN h < 0 THEN h::HUGEINT + 18446744073709551616 ELSE h::HUGEINT END AS u FROM reps), blocks AS ({cut})"


def _exact_pairs(r: int) -> str:
    return REPS + f", pairs AS (SELECT q.ord AS q, c.ord AS c, bit_count(xor(q.h, c.h))::INT AS distance FROM reps q JOIN reps c ON c.ord < q.ord WHERE bit_count(xor(q.h, c.h)) <= {r})"


_MIH = REPS + _blocks(8) + """,
checks AS (SELECT q.ord AS q, c.ord AS c, row_number() OVER (PARTITION BY q.ord ORDER BY q.block, c.ord) AS n FROM blocks q JOIN blocks c ON q.block = c.block AND q.key = c.key AND c.ord < q.ord),
pairs AS (SELECT DISTINCT k.q, k.c, bit_count(xor(q.h, c.h))::INT AS distance FROM checks k JOIN reps q ON q.ord = k.q JOIN reps c ON c.ord = k.c WHERE k.n <= {0} AND bit_count(xor(q.h, c.h)) <= 8)"""
MIH = _MIH.replace("{0}", "256")


def _components(name: str, edges: str) -> str:
    """``name(ord, group_id)`` of every vertex of ``edges(q, c)``."""
    return f""",
{name}_e AS (SELECT q AS x, c AS y FROM {edges} UNION SELECT c, q FROM {edges}),
{name}_r AS (SELECT x, y FROM {name}_e UNION SELECT r.x, e.y FROM {name}_r r JOIN {name}_e e ON r.y = e.x),
{name} AS (SELECT x AS ord, least(x, min(y)) AS group_id FROM {name}_r GROUP BY x)"""


MODIFIED = MIH + f", mod_pairs AS (SELECT p.q, p.c FROM pairs p JOIN reps q ON q.ord = p.q JOIN reps c ON c.ord = p.c WHERE {PASS})" + _components("modified", "mod_pairs")


def _lsh(rows: str, limit: int = 256) -> str:
    """``cands(q, c)`` of rows that have a vector."""
    last = "cands AS (SELECT q, c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos, c) AS n FROM met) WHERE n <= " + str(limit) + ")" if limit else "cands AS (SELECT q, c FROM met)"
    return f""",
plane AS (SELECT list_transform(string_split('{_SIGNS}', ''), lambda x: CASE x WHEN '1' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s),
whole AS (SELECT * FROM {rows} WHERE len(embedding) > 0),
shape AS (SELECT least(16, greatest(8, ceil(log2(count(*)))))::INT AS bits, max(len(embedding))::INT AS dim FROM whole),
projected AS (SELECT ord, t.tbl, k.k, list_inner_product(embedding::DOUBLE[], list_slice(s, (t.tbl * bits + k.k) * dim + 1, (t.tbl * bits + k.k) * dim + dim)) AS d
  FROM whole, plane, shape, (SELECT unnest(range(0, 12)) AS tbl) t, (SELECT unnest(range(0, 16)) AS k) k WHERE k.k < bits),
sigs AS (SELECT ord, tbl::INT AS tbl, sum(CASE WHEN d >= 0 THEN 1 << k::INT ELSE 0 END)::INT AS sig FROM projected GROUP BY ord, tbl),
probes AS (SELECT ord, tbl, 0 AS probe, sig FROM sigs UNION ALL SELECT ord, tbl, b.b + 1, xor(sig, 1 << b.b::INT) FROM sigs, shape, (SELECT unnest(range(0, 16)) AS b) b WHERE b.b < bits),
met AS (SELECT q.ord AS q, c.ord AS c, min(q.tbl * 64 + q.probe) AS pos FROM probes q JOIN sigs c ON q.tbl = c.tbl AND q.sig = c.sig AND c.ord < q.ord GROUP BY q.ord, c.ord),
{last}"""


_COSINE = "(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))))::FLOAT"


def _related(rows: str, mod: str) -> str:
    """``compared(q, c, cosine)`` and components ``related``."""
    return f""",
compared AS (SELECT k.q, k.c, {_COSINE} AS cosine FROM cands k JOIN {rows} q ON q.ord = k.q JOIN {rows} c ON c.ord = k.c
  LEFT JOIN {mod} mq ON mq.ord = k.q LEFT JOIN {mod} mc ON mc.ord = k.c WHERE NOT coalesce(mq.group_id = mc.group_id, false) AND {PASS}),
rel_pairs AS (SELECT q, c FROM compared WHERE cosine >= 0.40::FLOAT)""" + _components("related", "rel_pairs")


_EXACT = "exact AS (SELECT ord, min(ord) OVER w AS group_id, count(*) OVER w AS n FROM docs WINDOW w AS (PARTITION BY content_hash))"
CLUSTER = (
    MODIFIED
    + _lsh("reps")
    + _related("reps", "modified")
    + f""", {_EXACT},
members AS (SELECT 'EXACT' AS kind, group_id, ord FROM exact WHERE n >= 2 UNION ALL SELECT 'MODIFIED_COPY', group_id, ord FROM modified UNION ALL SELECT 'RELATED', group_id, ord FROM related),
clusters AS (SELECT m.kind, m.group_id, m.ord, row_number() OVER (PARTITION BY m.kind, m.group_id ORDER BY m.ord)::INT AS member_pos, d.id FROM members m JOIN docs d ON d.ord = m.ord)"""
)
VECTORS = "vecs AS (SELECT vec_id AS ord, 'v' || vec_id AS id, embedding, NULL::INT AS width, NULL::INT AS height, NULL::BIGINT AS file_size FROM embeddings), nomod AS (SELECT 0::BIGINT AS ord, 0::BIGINT AS group_id WHERE false)"
_SUGGESTED = ", suggested AS (SELECT DISTINCT id FROM clusters WHERE kind IN ('EXACT', 'MODIFIED_COPY') AND member_pos > 1)"
_EXPOSED = CODES + """,
lit AS (SELECT 'd' || doc_id AS id, list_sum(codes)::DOUBLE / len(codes) AS m, len(list_filter(codes, lambda x: x <= 15)) / len(codes)::DOUBLE AS dark, len(list_filter(codes, lambda x: x >= 240)) / len(codes)::DOUBLE AS bright FROM coded),
exposed AS (SELECT id, CASE WHEN m < 50 OR dark > 0.6::DOUBLE THEN 'UNDEREXPOSED' WHEN m > 205 OR bright > 0.6::DOUBLE THEN 'OVEREXPOSED' ELSE 'NORMAL' END AS classification, m, dark, bright FROM lit)"""
_TRIPLES = CODES + ", triples AS (SELECT 'd' || doc_id AS id, list_concat(codes, list_transform(range(0, (3 - len(codes) % 3) % 3), lambda k: 0)) AS t FROM coded)"
_DIGEST = "SELECT id, len(v)::INT AS n, md5(array_to_string(v, ',')) AS digest FROM (SELECT id, {0} AS v FROM triples)"
_POSITIONED = "SELECT '{0}' AS kind, group_id, row_number() OVER (PARTITION BY group_id ORDER BY ord)::INT AS member_pos, id FROM {1} JOIN {2} USING (ord)"
#: Pairs of the members that stay when every third row goes.
_LEFT = """SELECT kind, group_id, left_id, right_id, exact_match, hamming_distance FROM (
SELECT l.kind, l.group_id, l.id AS left_id, r.id AS right_id, q.content_hash = c.content_hash AS exact_match, bit_count(xor(q.h, c.h))::INT AS hamming_distance,
  row_number() OVER (PARTITION BY l.kind, l.group_id ORDER BY l.member_pos, r.member_pos) AS n
FROM clusters l JOIN clusters r ON l.kind = r.kind AND l.group_id = r.group_id AND l.member_pos < r.member_pos JOIN docs q ON q.ord = l.ord JOIN docs c ON c.ord = r.ord
WHERE l.ord % 3 <> 0 AND r.ord % 3 <> 0) WHERE n <= 20"""


def _q(steps: str, select: str) -> str:
    return f"WITH RECURSIVE {steps.strip().lstrip(',')}\n{select}"


ORACLES = {
    "exact_groups": _q(DOCS + ", " + _EXACT, _POSITIONED.format("EXACT", "(SELECT * FROM exact WHERE n >= 2)", "docs")),
    "representatives": _q(REPS, "SELECT id, ord FROM reps"),
    "sha256_hash": "SELECT 'd' || doc_id AS id, sha256(text) AS content_hash FROM documents",
    "dhash": _q(DOCS, "SELECT id, h AS perceptual_hash FROM docs"),
    "exposure": _q(_EXPOSED, "SELECT id, classification, round(m, 6) AS mean_luminance, round(dark, 6) AS dark_pixel_ratio, round(bright, 6) AS bright_pixel_ratio FROM exposed"),
    "exposure_labels": _q(_EXPOSED, "SELECT id, CASE classification WHEN 'UNDEREXPOSED' THEN 'Possibly underexposed' WHEN 'OVEREXPOSED' THEN 'Possibly overexposed' ELSE 'Normal exposure' END AS label FROM exposed"),
    "luminance": _q(_TRIPLES, _DIGEST.format("list_transform(range(0, len(t) // 3), lambda k: trunc(0.299::DOUBLE * t[k * 3 + 1] + 0.587::DOUBLE * t[k * 3 + 2] + 0.114::DOUBLE * t[k * 3 + 3])::INT)")),
    "rgb_normalise": _q(_TRIPLES, _DIGEST.format("list_transform(t, lambda x: round((x / 255.0::DOUBLE)::FLOAT::DOUBLE * 1000000)::BIGINT)")),
    "hamming_pairs": _q(_exact_pairs(4), "SELECT q, c, distance FROM pairs"),
    "mih_blocks": _q(REPS + _blocks(8), "SELECT ord, block, key FROM blocks"),
    "mih_candidates_exact": _q(_exact_pairs(8), "SELECT q, c, distance FROM pairs"),
    "mih_candidates_capped": _q(MIH, "SELECT q, c, distance FROM pairs"),
    "mih_candidates_tight": _q(_MIH.replace("{0}", "32"), "SELECT q, c, distance FROM pairs"),
    "lsh_candidates_tight": _q(VECTORS + _lsh("vecs", 24), "SELECT q, c FROM cands"),
    "metadata_filter_pairs": _q(_exact_pairs(8), f"SELECT p.q, p.c, {PASS} AS passes FROM pairs p JOIN reps q ON q.ord = p.q JOIN reps c ON c.ord = p.c"),
    "lsh_signatures": _q(VECTORS + _lsh("vecs"), "SELECT ord, tbl, sig FROM sigs"),
    "lsh_candidates": _q(VECTORS + _lsh("vecs", 0), "SELECT q, c FROM cands"),
    "lsh_candidates_capped": _q(VECTORS + _lsh("vecs"), "SELECT q, c FROM cands"),
    "cosine_pairs": _q(VECTORS + _lsh("vecs") + _related("vecs", "nomod"), "SELECT q, c, round(cosine::DOUBLE, 5) AS cosine FROM compared WHERE cosine >= 0.40::FLOAT"),
    "modified_groups": _q(MODIFIED, _POSITIONED.format("MODIFIED_COPY", "modified", "reps")),
    "related_groups": _q(VECTORS + _lsh("vecs") + _related("vecs", "nomod"), _POSITIONED.format("RELATED", "related", "vecs")),
    "cluster_all": _q(CLUSTER, "SELECT kind, group_id, member_pos, id FROM clusters"),
    "singletons": _q(CLUSTER, """SELECT k.kind, d.id FROM docs d, (VALUES ('EXACT'), ('MODIFIED_COPY'), ('RELATED')) k(kind)
WHERE d.ord NOT IN (SELECT ord FROM members) AND (k.kind <> 'RELATED' OR len(d.embedding) > 0)"""),
    "evidence_pairs": _q(CLUSTER, f"""SELECT kind, group_id, left_id, right_id, exact_match, hamming_distance, cosine_similarity FROM (
SELECT l.kind, l.group_id, l.id AS left_id, r.id AS right_id, q.content_hash = c.content_hash AS exact_match, bit_count(xor(q.h, c.h))::INT AS hamming_distance,
  CASE WHEN len(q.embedding) > 0 AND len(c.embedding) > 0 THEN round({_COSINE}::DOUBLE, 5) ELSE 0 END AS cosine_similarity,
  row_number() OVER (PARTITION BY l.kind, l.group_id ORDER BY l.member_pos, r.member_pos) AS n
FROM clusters l JOIN clusters r ON l.kind = r.kind AND l.group_id = r.group_id AND l.member_pos < r.member_pos JOIN docs q ON q.ord = l.ord JOIN docs c ON c.ord = r.ord) WHERE n <= 20"""),
    "cleanup_suggestions": _q(CLUSTER + _SUGGESTED, "SELECT id FROM suggested"),
    "selected_bytes": _q(CLUSTER + _SUGGESTED, "SELECT coalesce(sum(file_size), 0)::BIGINT AS bytes FROM docs WHERE id IN (SELECT id FROM suggested)"),
    "summary_counts": _q(CLUSTER + "," + _EXPOSED, """SELECT (SELECT count(*) FROM docs) AS photos, count(*) FILTER (WHERE kind <> 'RELATED') AS duplicate_groups, count(*) FILTER (WHERE kind = 'RELATED') AS related_groups,
(SELECT count(*) FROM exposed WHERE classification <> 'NORMAL') AS warnings FROM clusters WHERE member_pos = 1"""),
    "numbered_groups": _q(CLUSTER, "SELECT kind, group_id, row_number() OVER (PARTITION BY kind ORDER BY group_id)::INT AS number FROM clusters WHERE member_pos = 1"),
    "delete_regroup": _q(CLUSTER, """SELECT kind, group_id, member_pos, id FROM (SELECT kind, group_id, row_number() OVER (PARTITION BY kind, group_id ORDER BY ord)::INT AS member_pos, id,
count(*) OVER (PARTITION BY kind, group_id) AS n FROM clusters WHERE ord % 3 <> 0) WHERE n >= 2"""),
    "delete_rows": "SELECT 'd' || doc_id AS id FROM documents WHERE doc_id % 3 <> 0",
    "embedding_comparisons": _q(CLUSTER, "SELECT count(*) AS embedding_comparisons FROM compared"),
    "l2_normalise": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3::FLOAT)::FLOAT) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[]))::FLOAT AS s FROM e)
SELECT vec_id, k::INT AS pos, round((v[k::INT + 1]::DOUBLE / s::DOUBLE)::FLOAT::DOUBLE, 5) AS value FROM n, (SELECT unnest(range(0, 64)) AS k)""",
    "format_bytes": """SELECT id, CASE WHEN b <= 0 THEN 'Size unavailable' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0::DOUBLE)
ELSE printf('%.1f GB', b / 1073741824.0::DOUBLE) END AS text FROM (SELECT 'd' || doc_id AS id, strlen(text) * 97 - 9700 AS b FROM documents)""",
    "format_number": "SELECT 'd' || doc_id AS id, printf('%.0f', strlen(text)::DOUBLE) AS text FROM documents",
    "preview_size": """SELECT id, greatest(1, floor(w * s + 0.5))::INT AS width, greatest(1, floor(h * s + 0.5))::INT AS height FROM
(SELECT *, least(1.0::DOUBLE, 512.0::DOUBLE / greatest(w, h, 1)) AS s FROM (SELECT 'd' || doc_id AS id, length(text) AS w, len(string_split(text, chr(10))) AS h FROM documents))""",
    "hash_components": _q(_exact_pairs(4) + _components("joined", "pairs"), "SELECT ord AS node, group_id AS component FROM joined"),
    "application_groups": _q(CLUSTER, "SELECT kind, group_id, member_pos, id FROM clusters"),
    "evidence_preview": _q(CLUSTER, """SELECT kind, group_id, left_id, right_id, hamming_distance FROM (
SELECT l.kind, l.group_id, l.id AS left_id, r.id AS right_id, bit_count(xor(q.h, c.h))::INT AS hamming_distance, row_number() OVER (PARTITION BY l.kind, l.group_id ORDER BY l.member_pos, r.member_pos) AS n
FROM clusters l JOIN clusters r ON l.kind = r.kind AND l.group_id = r.group_id AND l.member_pos < r.member_pos JOIN docs q ON q.ord = l.ord JOIN docs c ON c.ord = r.ord) WHERE n <= 3"""),
    "evidence_labels": _q(CLUSTER, f"""SELECT kind, group_id, left_id, right_id, CASE kind WHEN 'EXACT' THEN 'Matching SHA-256 file hashes' WHEN 'MODIFIED_COPY' THEN bits || ' (passes at ≤ 8) • ' || model ELSE model || ' (passes at ≥ 85.0%) • ' || bits END AS label FROM (
SELECT l.kind, l.group_id, l.id AS left_id, r.id AS right_id, 'dHash ' || bit_count(xor(q.h, c.h)) || '/64' AS bits,
  'MobileNet ' || printf('%.1f%%', round((CASE WHEN len(q.embedding) > 0 AND len(c.embedding) > 0 THEN {_COSINE} ELSE 0::FLOAT END * 100::FLOAT)::DOUBLE, 1)) AS model,
  row_number() OVER (PARTITION BY l.kind, l.group_id ORDER BY l.member_pos, r.member_pos) AS n
FROM clusters l JOIN clusters r ON l.kind = r.kind AND l.group_id = r.group_id AND l.member_pos < r.member_pos JOIN docs q ON q.ord = l.ord JOIN docs c ON c.ord = r.ord) WHERE n <= 20"""),
    "selection_evidence": _q(DOCS, """SELECT left_id, right_id, exact_match, hamming_distance FROM (
SELECT q.id AS left_id, c.id AS right_id, q.content_hash = c.content_hash AS exact_match, bit_count(xor(q.h, c.h))::INT AS hamming_distance, row_number() OVER (ORDER BY q.ord, c.ord) AS n
FROM docs q JOIN docs c ON q.ord < c.ord) WHERE n <= 20"""),
    "evidence_missing": _q(CLUSTER, _LEFT),
    "delete_regroup_evidence": _q(CLUSTER, _LEFT),
    "evidence_names": _q(CLUSTER, """SELECT kind, group_id, left_id, right_id, CASE WHEN a % 2 = 0 THEN 'name of ' || left_id ELSE left_id END AS left_name, CASE WHEN b % 2 = 0 THEN 'name of ' || right_id ELSE right_id END AS right_name FROM (
SELECT l.kind, l.group_id, l.id AS left_id, r.id AS right_id, l.ord AS a, r.ord AS b, row_number() OVER (PARTITION BY l.kind, l.group_id ORDER BY l.member_pos, r.member_pos) AS n
FROM clusters l JOIN clusters r ON l.kind = r.kind AND l.group_id = r.group_id AND l.member_pos < r.member_pos) WHERE n <= 20"""),
    "flat_groups": _q(CLUSTER, """SELECT group_id, CASE kind WHEN 'EXACT' THEN '0' WHEN 'MODIFIED_COPY' THEN '1' ELSE '2' END || ',' || count(*) || ',' || string_agg(ord::VARCHAR, ',' ORDER BY member_pos) AS flat
FROM clusters GROUP BY kind, group_id"""),
    "decoded_groups": _q(CLUSTER, "SELECT kind, group_id, member_pos, id FROM clusters"),
    "written_groups": _q(CLUSTER, "SELECT kind, group_id, member_pos, id FROM clusters"),
    "known_dimensions": """SELECT 'd' || doc_id AS id, greatest(length(text) - 500, 0)::INT AS width, CASE WHEN doc_id % 3 > 0 THEN len(string_split(text, chr(10))) ELSE 0 END::INT AS height,
greatest(strlen(text) - 700, 0)::BIGINT AS file_size FROM documents""",
    "validation_report": " UNION ALL ".join(
        f"""SELECT '{name}' AS fixture, bool_or(id = '') AS empty_ids, count(*) <> count(DISTINCT id) AS repeated_ids, min(len(e)) <> max(len(e)) AS mixed_dimensions,
bool_or(len(list_filter(e, lambda x: NOT isfinite(x))) > 0) AS odd_values FROM (SELECT {id_} AS id, {e} AS e FROM embeddings)"""
        for name, id_, e in (
            ("clean", "'v' || vec_id", "embedding"),
            ("empty", "CASE WHEN vec_id % 100 = 7 THEN '' ELSE 'v' || vec_id END", "embedding"),
            ("repeated", "'v' || (vec_id // 2)", "embedding"),
            ("dimension", "'v' || vec_id", "CASE WHEN vec_id % 100 = 7 THEN embedding[1:63] ELSE embedding END"),
            ("odd", "'v' || vec_id", "CASE WHEN vec_id % 100 = 7 THEN list_transform(embedding, lambda x: 'nan'::FLOAT) ELSE embedding END"),
        )
    ),
    "member_chunks": _q(CLUSTER, "SELECT kind, group_id, id, ((member_pos - 1) // 2)::INT AS chunk FROM clusters"),
    "toggled_selection": "SELECT 'd' || doc_id AS id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'd1'",
    "delete_message": """SELECT CASE WHEN good = 0 THEN 'No photos were deleted. The selected storage provider may not allow deletion.' WHEN good = n THEN 'Deleted ' || n || ' photo' || CASE WHEN n = 1 THEN '.' ELSE 's.' END
ELSE 'Deleted ' || good || '; ' || (n - good) || ' could not be deleted.' END AS message FROM (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS good FROM documents)""",
    "display_names": "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, nullif(lang, ''), 'Unnamed image') AS display_name FROM documents",
    "selected_files": _q(REPS, "SELECT id, ord FROM reps ORDER BY ord LIMIT 100"),
    "columnar_source": """SELECT vec_id || '-' || k AS id, vec_id || '-' || k AS content_hash, vec_id AS perceptual_hash, 9 AS width, 72::BIGINT AS file_size, round(embedding[k::INT * 16 + 1]::DOUBLE, 6) AS first_value
FROM embeddings, (SELECT unnest(range(0, 4)) AS k)""",
    "progress_ratio": "SELECT 'd' || doc_id AS id, round(CASE WHEN strlen(text) > 0 THEN doc_id::DOUBLE / strlen(text) ELSE 0 END::FLOAT::DOUBLE, 4) AS ratio FROM documents",
    "plural_labels": "SELECT 'd' || doc_id AS id, doc_id || ' photo' || CASE WHEN doc_id = 1 THEN '' ELSE 's' END AS label FROM documents",
}

#: Counterparts of the group queries whose searches have no cap.
_ALL_PAIRS, _ALL_CANDS = _exact_pairs(8), _lsh("reps", 0)
ORACLES |= {
    "modified_groups_uncapped": ORACLES["modified_groups"].replace(MIH.strip(), _ALL_PAIRS.strip()),
    "related_groups_uncapped": ORACLES["related_groups"].replace(_lsh("vecs"), _lsh("vecs", 0)),
    "cluster_all_uncapped": ORACLES["cluster_all"].replace(MIH.strip(), _ALL_PAIRS.strip()).replace(_lsh("reps"), _ALL_CANDS),
}
