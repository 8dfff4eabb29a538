"""DuckDB SQL for the queries that SQL can express exactly."""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, text, coalesce(source, chr(0)) site FROM documents),
split AS (SELECT r, doc_id, site, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos
  FROM d WHERE text IS NOT NULL),
lines AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) norm FROM split),
spread AS (SELECT norm, min(doc_id) first_doc FROM lines WHERE len(string_split(norm, ' ')) >= 3
  GROUP BY norm HAVING count(DISTINCT site) >= 3),
marked AS (SELECT l.*, s.norm IS NOT NULL AND l.doc_id IS DISTINCT FROM s.first_doc gone FROM lines l LEFT JOIN spread s USING (norm)),
joined AS (SELECT r, count(*) n_lines, count(*) FILTER (gone) n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') text
  FROM marked GROUP BY r)
SELECT d.doc_id, joined.text, coalesce(n_lines, 0)::BIGINT n_lines, coalesce(n_removed, 0)::BIGINT n_removed,
  coalesce(n_removed > 0 AND NOT regexp_matches(joined.text, '[^\x20\x09-\x0D]'), false) emptied
FROM d LEFT JOIN joined USING (r)
"""

_RENDERED = r"""
said AS (SELECT conv_id, turn, CASE WHEN role IS NULL THEN 'unknown' WHEN rtrim(role, chr(39)) = 'unknown' THEN role || chr(39) ELSE role END name,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') text FROM conversations),
speakers AS (SELECT DISTINCT conv_id conv, name perspective FROM said WHERE name <> 'system'),
both_ AS (SELECT *, CASE WHEN name = perspective THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user' END "role",
  replace(replace(regexp_replace(name, '[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]', ' ', 'g'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') shown
  FROM said JOIN speakers ON conv_id IS NOT DISTINCT FROM conv),
headed AS (SELECT *, '<|im_start|>' || "role" || CASE WHEN "role" = 'user' THEN ' name=' || shown ELSE '' END || chr(10) head FROM both_),
segments AS (SELECT conv_id, perspective, turn, name, "role", head || text || '<|im_end|>' || chr(10) segment,
  CASE WHEN "role" = 'assistant' THEN length(head) ELSE 0 END::BIGINT mask_start,
  CASE WHEN "role" = 'assistant' THEN length(head) + length(text) + 10 ELSE 0 END::BIGINT mask_end FROM headed)"""

OP4 = f"""
WITH {_RENDERED}
SELECT conv_id, perspective, turn, name, "role", segment, mask_start, mask_end FROM segments
"""

DIALOGUES = f"""
WITH {_RENDERED},
placed AS (SELECT *, floor(coalesce(turn, 0) / 64)::BIGINT part FROM segments),
at_ AS (SELECT *, row_number() OVER o place, coalesce(sum(length(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT at_
  FROM placed WINDOW o AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, name NULLS FIRST, segment))
SELECT conv_id, perspective, part, string_agg(segment, '' ORDER BY place) text,
  coalesce(string_agg((at_ + mask_start)::VARCHAR || '-' || (at_ + mask_end)::VARCHAR, ',' ORDER BY place) FILTER (mask_end > 0), '') masks
FROM at_ GROUP BY conv_id, perspective, part
"""

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, {_WORDS} w FROM documents),
b AS (SELECT item_id, {_WORDS} w FROM benchmark),
starts AS (SELECT item_id, w, least(10, len(w)) size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') gram FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') gram
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) i FROM d JOIN sizes ON len(w) >= size)),
found AS (SELECT r, i, g.size, item_id FROM grams g JOIN windows v ON g.size = v.size AND g.gram = v.gram),
hit AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(i, i + size)) p FROM found) GROUP BY r),
items AS (SELECT r, count(*) n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) ids
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT h FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT weight, sum(source_size) OVER () total FROM s),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER o, 0)::DOUBLE full_, coalesce(sum(weight) OVER o, 0)::DOUBLE used_, sum(weight) OVER ()::DOUBLE weights
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max((total - full_) / (weights - used_)) OVER () level_ FROM c),
t AS (SELECT source, source_size, least(3 * source_size::DOUBLE, level_ * weight) target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END copies FROM t),
g AS (SELECT source, h, sum(size)::BIGINT words FROM d GROUP BY source, h HAVING sum(size) > 0),
run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) upto FROM g),
cut AS (SELECT p.source, min(h) edge, arg_min(upto - words, h) before_, arg_min(words, h) words, any_value(target - copies * source_size) budget
  FROM p JOIN run ON p.source IS NOT DISTINCT FROM run.source AND upto > target - copies * source_size GROUP BY p.source)
SELECT doc_id, size, source_size, target,
  size * (copies + CASE WHEN edge IS NULL OR h < edge OR (h = edge AND budget - before_ >= before_ + words - budget) THEN 1 ELSE 0 END)::BIGINT taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ AS (SELECT x doc_id, min(y) m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""


def op11(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every round is a CTE of its own: nearest entries, then sums divided and rounded down.

    Squares and products stay far below 2 ** 53, where doubles are exact.
    """
    cut = f"len(x) // {parts}"
    out = rf"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) r, vec_id, label, [floor(1024 * c::DOUBLE) for c in embedding] x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * ({cut}) + 1 : (part + 1) * ({cut})] y FROM v, range({parts}) q(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 entry, y FROM p WHERE r <= {entries})"""
    for k in range(rounds + 1):
        out += rf""",
a{k} AS MATERIALIZED (SELECT p.r, p.part, min(struct_pack(d := list_dot_product(p.y, p.y) + list_dot_product(c.y, c.y) - 2 * list_dot_product(p.y, c.y), entry := c.entry)) best
  FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.r, p.part)"""
        if k < rounds:
            out += rf""",
s{k} AS (SELECT part, entry, list(m ORDER BY i) y FROM (SELECT a.part, a.best.entry entry, i, floor(sum(p.y[i]) / count(*)) m
  FROM a{k} a JOIN p ON p.r = a.r AND p.part = a.part, range(1, {1 << 20}) g(i) WHERE i <= len(p.y) GROUP BY ALL) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(s.y, c.y) y FROM c{k} c LEFT JOIN s{k} s ON s.part = c.part AND s.entry = c.entry)"""
    return out + rf""",
coded AS (SELECT r, string_agg(lpad(to_hex(best.entry), 2, '0'), '' ORDER BY part) code, sum(best.d)::BIGINT error FROM a{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(n::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) digest
  FROM (SELECT part, entry, unnest(y) n, unnest(range(len(y))) i FROM c{rounds}))
SELECT vec_id, lower(code) code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error, digest codebooks_sha256
FROM v JOIN coded USING (r), books
"""


OP11 = op11()

# crc32 by bytes over its table of 256 remainders, which a recursive query makes from the polynomial.
OP12 = rf"""
WITH RECURSIVE step AS (SELECT i b, i c, 0 k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) t FROM step WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, {_WORDS} w FROM documents),
f AS (SELECT r, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) g FROM d),
g AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) g FROM (SELECT {_WORDS} w FROM benchmark)),
n AS MATERIALIZED (SELECT r, g, count(*) n FROM f GROUP BY r, g),
names AS (SELECT g FROM n UNION SELECT g FROM g),
bucket AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h)::BIGINT for h in regexp_extract_all(hex(g), '..')]),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 10000 k FROM names, crc),
s AS (SELECT k, sum(n) s FROM n JOIN bucket USING (g) GROUP BY k),
t AS (SELECT k, count(*) t FROM g JOIN bucket USING (g) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT gain FROM s FULL JOIN t USING (k)),
mean AS (SELECT r, sum(n)::BIGINT n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT weight FROM n JOIN bucket USING (g) JOIN gain USING (k) GROUP BY r),
scored AS (SELECT doc_id, len(w) n_words, coalesce(n_features, 0)::BIGINT n_features, coalesce(weight, 0)::BIGINT weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT score
  FROM d LEFT JOIN mean USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) place, count(*) OVER (PARTITION BY n_words >= 20) n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS "rank" FROM ranked
"""
