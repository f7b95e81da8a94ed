"""DuckDB SQL of the queries that SQL can express."""

#: Base32 of SHA-1: the digest's hexadecimal digits as bits, five bits a letter.
WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || bin(instr('0123456789abcdef', sha[i]) - 1), 4)), '') AS bits FROM f)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j: (bits[5 * k + j + 1])::INT * (16 >> j)))::INT]), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url AS target_uri
FROM b"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i, unnest(range(35)) AS k FROM rep)),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept FROM x LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


LEXICAL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(t))::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
x AS (SELECT item_id, text, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""


#: A CRC is linear: the exclusive or of what every byte adds at its distance from the end, and of the CRC of as many zero bytes.
#: For Levenshtein's bytes to be code points, the 64 letters beyond ASCII are written as the 64 ASCII characters before a.
VARIANTS = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, coalesce(doc_id::VARCHAR, '') || ':' AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
u AS (SELECT r, any_value(id) AS id, run, count(*)::BIGINT AS n FROM (SELECT r, id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM d) GROUP BY r, run),
m AS (SELECT row_number() OVER () AS k, run, n, hex(encode(id || run)) AS bytes FROM u),
t AS (SELECT i::UBIGINT AS i, 0 AS k, i::UBIGINT AS c FROM range(256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS (SELECT i, c FROM t WHERE k = 8),
longest AS (SELECT max(len(bytes)) // 2 AS most FROM m),
con AS (SELECT i AS byte, 0 AS far, c FROM tab UNION ALL SELECT byte, far + 1, xor(con.c >> 8, tab.c) FROM con JOIN tab ON tab.i = con.c % 256, longest WHERE far + 1 < most),
zero AS (SELECT 0 AS n, 4294967295::UBIGINT AS c UNION ALL SELECT n + 1, xor(zero.c >> 8, tab.c) FROM zero JOIN tab ON tab.i = zero.c % 256, longest WHERE n < most),
p AS (SELECT k, len(bytes) // 2 AS size, unnest(range(len(bytes) // 2)) AS pos, bytes FROM m),
s AS (SELECT k, any_value(size) AS size, bit_xor(c) AS c FROM p JOIN con ON far = size - 1 - pos AND byte = ('0x' || substr(bytes, (2 * pos + 1)::INT, 2))::UBIGINT GROUP BY k),
h AS (SELECT k, (xor(xor(s.c, zero.c), 4294967295::UBIGINT))::BIGINT AS h FROM s JOIN zero ON zero.n = s.size),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM m JOIN h USING (k) GROUP BY 1),
v AS (SELECT word, n, translate(word, (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(192, 256) x(i)), (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(33, 97) x(i))) AS plain FROM w WHERE n >= 5 AND len(word) >= 6),
x AS (SELECT word, n, plain, plain AS part FROM v UNION SELECT word, n, plain, substr(plain, 1, i::INT - 1) || substr(plain, i::INT + 1) FROM (SELECT *, unnest(range(1, len(plain) + 1)) AS i FROM v)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b USING (part) WHERE a.word <> b.word AND levenshtein(a.plain, b.plain) = 1),
f AS (SELECT word, count(*)::BIGINT AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
up AS (SELECT word, word AS root, 0 AS steps FROM g UNION ALL SELECT up.word, g.form, steps + 1 FROM up JOIN g ON g.word = up.root WHERE g.form IS NOT NULL),
root AS (SELECT word, first(root ORDER BY steps DESC) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM g JOIN root USING (word)"""


def _drawn(*parts: str) -> str:
    text = " || '|' || ".join(("'0'", *parts))
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


#: A repetition limit of 2 without a budget: (largest share / smallest share) ** (1 - exponent) = 2 has a closed form.
MIXING = rf"""
WITH d AS (SELECT doc_id, source AS src, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
n AS (SELECT source, greatest(1, ceil(count(*) / 1024))::BIGINT AS blocks FROM d GROUP BY 1),
b AS (SELECT d.*, {_drawn('id')} % blocks AS block FROM d JOIN n USING (source)),
s AS (SELECT source, sum(tokens)::BIGINT AS total_of FROM b GROUP BY 1 HAVING sum(tokens) > 0),
a AS (SELECT sum(total_of)::BIGINT AS total, max(total_of) / sum(total_of)::DOUBLE AS largest,
    round(CASE WHEN max(total_of) <= 2 * min(total_of) THEN 0 ELSE 1 - ln(2) / ln(max(total_of) / min(total_of)::DOUBLE) END, 9) AS exponent FROM s),
z AS (SELECT sum(pow(total_of / total::DOUBLE, exponent)) AS z FROM s, a),
w AS (SELECT source, total_of, exponent, round(pow(total_of / total::DOUBLE, exponent) / z, 12) AS weight,
    greatest(floor(round(pow(total_of / total::DOUBLE, exponent) / z, 12) * (total * largest / (pow(largest, exponent) / z)) + 1e-6), total_of)::BIGINT AS budget FROM s, a, z),
k AS (SELECT source, block, sum(tokens)::BIGINT AS in_block FROM b GROUP BY 1, 2),
e AS (SELECT *, budget // total_of AS whole, budget % total_of AS rest, unnest(range(0, budget // total_of + 1)) AS epoch FROM k JOIN w USING (source)),
r AS (SELECT *, row_number() OVER o AS rank, sum(in_block) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS after FROM e
  WINDOW o AS (PARTITION BY source, epoch ORDER BY {_drawn("'block'", 'epoch', 'source', 'block')}, block)),
p AS (SELECT *, epoch = whole AND after > rest AS cut FROM r WHERE epoch < whole OR after - in_block < rest),
m AS (SELECT b.*, exponent, weight, budget, epoch, rank, cut, rest - after + in_block AS room, {_drawn("'doc'", 'epoch', 'id')} AS draw FROM b JOIN p USING (source, block)),
f AS (SELECT *, sum(tokens) OVER (PARTITION BY source, block, epoch ORDER BY draw RANGE UNBOUNDED PRECEDING) AS so_far FROM m)
SELECT doc_id, src AS source, exponent, weight, budget, tokens, epoch, rank::INTEGER AS block, draw FROM f WHERE NOT cut OR so_far <= room"""
