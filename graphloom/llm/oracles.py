"""DuckDB SQL for those queries of this subpackage that SQL can express, whole or in part."""

from __future__ import annotations

from .private import BYTE, MARKS, SPACE, WORD, Disclosure
from .quality import Limits
from .urls import LOWER, REACH, STEPS, STRONGEST, UNKNOWN, UPPER, WEAKEST, Reputation, Rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def crc32(codes: str) -> str:
    """CRC-32 of a list of byte values."""
    step = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte))"
    return f"xor(list_reduce({codes}, lambda crc, byte: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _repeated(size: int, name: str) -> str:
    """Words in windows of ``size`` words that occur twice or more in their text."""
    key = f"md5(array_to_string(w[i : i + {size - 1}], ' '))"
    return f"""{name} AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {size})) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS times FROM (SELECT rid, i, {key} AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {size - 2})) AS i FROM t WHERE len(w) >= {size}))) WHERE times > 1) GROUP BY rid)"""


def quality(limits: Limits = Limits()) -> str:
    """op2 whole.  The longest repeat is found by halving steps: classes of equal windows of 2**j words extend those found so far."""
    top = 15
    levels = ["c0 AS (SELECT rid, i, min(i) OVER (PARTITION BY rid, x) AS c FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t))"]
    for j in range(1, top):
        levels.append(f"c{j} AS (SELECT a.rid, a.i, min(a.i) OVER (PARTITION BY a.rid, a.c, b.c) AS c FROM c{j - 1} a JOIN c{j - 1} b ON b.rid = a.rid AND b.i = a.i + {2 ** (j - 1)})")
    # l: words known to occur twice, c: class of the window of so many words from i on
    steps = [f"s{top} AS (SELECT rid, i, 0 AS l, CAST(0 AS BIGINT) AS c FROM c0)"]
    for j in reversed(range(top)):
        steps.append(f"d{j} AS (SELECT s.rid, s.i, s.l, min(s.i) OVER p AS c, count(*) OVER p AS times FROM s{j + 1} s JOIN c{j} b ON b.rid = s.rid AND b.i = s.i + s.l WINDOW p AS (PARTITION BY s.rid, s.c, b.c))")
        steps.append(f"g{j} AS (SELECT rid FROM d{j} GROUP BY rid HAVING max(times) > 1)")
        steps.append(f"s{j} AS (SELECT rid, i, l + {2 ** j} AS l, c FROM d{j} WHERE rid IN (SELECT rid FROM g{j}) UNION ALL SELECT rid, i, l, c FROM s{j + 1} WHERE rid NOT IN (SELECT rid FROM g{j}))")
    lines = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, {WORDS} AS w FROM documents),
{_repeated(8, 'r8')}, {_repeated(limits.min_span, 'rs')},
{', '.join(levels)}, {', '.join(steps)},
longest AS (SELECT rid, max(l) AS n FROM s0 GROUP BY rid),
base AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, len({lines}) - len(list_distinct({lines})) AS n_dup_lines, coalesce(r8.n, 0) AS n_repeat_words, coalesce(rs.n, 0) AS covered_words, CASE WHEN longest.n >= 8 THEN longest.n ELSE 0 END AS longest_repeat FROM t LEFT JOIN r8 USING (rid) LEFT JOIN rs USING (rid) LEFT JOIN longest USING (rid)),
judged AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND covered_words <= CAST({limits.max_covered} AS DOUBLE) * n_words AND longest_repeat <= {limits.max_longest} AND 100 * longest_repeat <= {limits.max_longest_percent} * n_words AS kept, CAST(covered_words AS BIGINT) AS covered_words, CAST(longest_repeat AS BIGINT) AS longest_repeat FROM judged"""


def urls(rules: Rules, model: Reputation = Reputation()) -> str:
    """op5 whole."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    two = ", ".join(f"'{x}'" for x in model.two_label_suffixes)
    last = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    level = lambda name: f"SELECT '{name}' AS level, sum(n) AS n, sum(bad) AS bad, count(*) AS groups, sum(CAST(n AS DOUBLE) * n) AS nn, sum(bad * bad / CAST(n AS DOUBLE)) AS q FROM {name}s WHERE n > 0"
    strength = f"CASE WHEN n > 0 AND groups >= 2 AND bad > 0 AND bad < n AND room > 0 THEN least(greatest(1 / least(greatest((spread - (groups - 1) + sqrt(2 * (groups - 1))) / room, 1e-4), 1.0) - 1, {WEAKEST}), {STRONGEST}) ELSE {UNKNOWN} END"
    f = lambda x: f"exp((2 * a - 1) * ln(sin({x})) + (2 * b - 1) * ln(cos({x})) - ((2 * a - 1) * ln(sin(middle)) + (2 * b - 1) * ln(cos(middle))))"
    part = lambda x, y: f"(({y}) - ({x})) * list_sum(list_transform(range({STEPS + 1}), lambda i: (CASE WHEN i = 0 OR i = {STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * {f(f'(({x}) + (({y}) - ({x})) * i / CAST({STEPS} AS DOUBLE))')}))"
    return f"""WITH cut AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)),
seen AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM cut LEFT JOIN seen ON page_id = doc_id GROUP BY host),
hosts AS (SELECT host, n, bad, CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM counted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
sums AS (SELECT *, bad / n AS p, n - nn / n - (groups - 1) AS room, (q - bad * bad / CAST(n AS DOUBLE)) / ((bad / CAST(n AS DOUBLE)) * (1 - bad / CAST(n AS DOUBLE))) AS spread FROM ({level('host')} UNION ALL {level('domain')} UNION ALL {level('suffix')})),
strong AS (SELECT max(CASE WHEN level = 'host' THEN s END) AS mh, max(CASE WHEN level = 'domain' THEN s END) AS md, max(CASE WHEN level = 'suffix' THEN s END) AS ms, (coalesce(max(CASE WHEN level = 'host' THEN bad END), 0) + {model.pseudo_bad}) / (coalesce(max(CASE WHEN level = 'host' THEN n END), 0) + {model.pseudo_pages}) AS usual FROM (SELECT level, n, bad, {strength} AS s FROM sums)),
up AS (SELECT h.host, h.n, h.bad, mh, usual, (d.bad + md * ((s.bad + ms * usual) / (s.n + ms))) / (d.n + md) AS up FROM hosts h JOIN domains d ON d.domain = h.domain AND d.suffix = h.suffix JOIN suffixs s ON s.suffix = h.suffix, strong),
beta AS (SELECT host, usual, greatest(bad + mh * up, 0.5) AS a, greatest(n - bad + mh * (1 - up), 0.5) AS b FROM up),
mid AS (SELECT *, asin(sqrt(a / (a + b))) AS middle, {REACH} / (2 * sqrt(a + b)) AS width FROM beta),
ends AS (SELECT *, greatest(middle - width, 1e-9) AS low, least(middle + width, pi() / 2 - 1e-9) AS high FROM mid),
limits AS (SELECT *, least(greatest(asin(sqrt(least(greatest({model.ratio} * usual, 0.0), 1.0))), low), high) AS edge FROM ends),
worse AS (SELECT host, {part('edge', 'high')} AS over_, {part('low', 'edge')} AS under_ FROM limits)
SELECT page_id, host, path, {rule} AS rule, coalesce({ruled}, CASE WHEN over_ / (over_ + under_) >= {model.probability} THEN 'block' ELSE 'allow' END) AS verdict, round(over_ / (over_ + under_), 6) AS worse FROM cut JOIN worse USING (host)"""


def substring(size: int = 50) -> str:
    """op10 whole."""
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT rid, doc_id, i, md5(array_to_string(w[i : i + {size - 1}], ' ')) AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM t WHERE len(w) >= {size} AND doc_id IS NOT NULL)),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + {size})) AS p FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id) GROUP BY rid),
left_ AS (SELECT doc_id, w, coalesce(len(ps), 0) AS n, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i))), lambda i: w[i]) END AS keep FROM t LEFT JOIN gone USING (rid))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(keep, ' '), '')) AS kept_sha256 FROM left_"""


def lm_base() -> str:
    """op6 without its model's score."""
    held = crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({held} % 7 = 2, true) AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), '') AS w FROM documents),
x AS (SELECT rid, unnest(w) AS k FROM t), c AS (SELECT k, count(*) AS c FROM x JOIN t USING (rid) WHERE NOT held_out GROUP BY k), s AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1.0) / CAST(n + v + 1 AS DOUBLE))), 6) AS base_score FROM t JOIN x USING (rid) LEFT JOIN c USING (k), s GROUP BY rid, doc_id, held_out"""


def warc_links() -> str:
    """op3 without ids, digests and lengths."""
    return """SELECT page_id, kind AS warc_type, coalesce(url, '') AS target_uri, CASE kind WHEN 'metadata' THEN 'application/warc-fields' ELSE 'text/plain; charset=utf-8' END AS content_type, true AS refers_to_response FROM pages, (VALUES ('metadata'), ('conversion')) AS k(kind)"""


def tiff_payloads(unit: int = 192) -> str:
    """op9's columns of the payload."""
    tail = "list_transform(range(16), lambda i: CAST('0x' || substr(tail, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"""WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, coalesce(text, '') || repeat(' ', CASE WHEN strlen(coalesce(text, '')) = 0 THEN {unit} ELSE (- strlen(text)) % {unit} + CASE WHEN strlen(text) % {unit} = 0 THEN 0 ELSE {unit} END END) AS payload FROM documents),
h AS (SELECT *, right(hex(encode(payload)), 32) AS tail FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_sha256, CAST({crc32(tail)} AS BIGINT) AS tail_crc32 FROM h"""


def _unsigned_crc32_of(column: str) -> str:
    return crc32(f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")


def trie(group: int = 20, heads: int = 4) -> str:
    """op12 whole: nodes by the hash of all their turns, subtrees by the paths of their owners."""
    return f"""WITH t AS (SELECT conv_id AS c, sha256(length(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS pos FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n, {_unsigned_crc32_of('c')} % {heads} AS h, c - c % {group} AS base FROM t GROUP BY c),
convs AS (SELECT n.c, n.base, n.h, least(n.h, coalesce(b.n, 0)) AS head, least(n.h, coalesce(b.n, 0)) + greatest(n.n - n.h, 0) AS len FROM n LEFT JOIN n b ON b.c = n.base),
r AS (SELECT convs.c, t.pos AS d, t.k, t.words FROM convs JOIN t ON t.c = convs.base AND t.pos <= head UNION ALL SELECT t.c, t.pos - h + head, t.k, t.words FROM t JOIN convs ON convs.c = t.c WHERE t.pos > h),
at_ AS (SELECT c, d, sha256(array_to_string(list(k) OVER (PARTITION BY c ORDER BY d), ',')) AS k, words FROM r UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT k, d, min(c) AS owner, count(*) AS n, any_value(words) AS words FROM at_ GROUP BY k, d),
up AS (SELECT v.k, a.k AS parent FROM nodes v JOIN at_ a ON a.c = v.owner AND a.d = v.d - 1),
kids AS (SELECT parent AS k, count(*) AS kids FROM up GROUP BY parent),
sums AS (SELECT a.k, sum((v.n - 1) * v.words) AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves FROM nodes v LEFT JOIN kids USING (k) JOIN at_ a ON a.c = v.owner AND a.d <= v.d GROUP BY a.k),
ends AS (SELECT k, string_agg(CAST(at_.c AS VARCHAR), ',' ORDER BY at_.c) AS ids FROM at_ JOIN convs ON convs.c = at_.c AND len = d GROUP BY k)
SELECT v.owner AS conv_id, CAST(v.d AS BIGINT) AS depth, p.owner AS parent_conv_id, v.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM nodes v LEFT JOIN up USING (k) LEFT JOIN nodes p ON p.k = up.parent LEFT JOIN kids ON kids.k = v.k JOIN sums ON sums.k = v.k LEFT JOIN ends ON ends.k = v.k"""


def runs(min_length: int = 6, exponent: int = 4) -> str:
    """op13 whole: words that agree q words apart, by pairs of equal 5-grams of a document at that distance."""
    k = min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS o, coalesce({_unsigned_crc32_of('doc_id')}, 1) AS h FROM documents),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM t),
p AS (SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (len(o) - a) // (3 + (h // 10) % 8) END AS p FROM a),
w AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN o ELSE list_transform(range(len(o)), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) END AS w FROM p),
g AS (SELECT rid, n, i, md5(array_to_string(w[i + 1 : i + {k}], ' ')) AS k FROM (SELECT rid, w, len(w) AS n, unnest(range(len(w) - {k - 1})) AS i FROM w WHERE len(w) >= {k})),
twice AS (SELECT *, count(*) OVER (PARTITION BY rid, k) AS times FROM g),
pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM twice x JOIN twice y ON y.rid = x.rid AND y.k = x.k AND y.i > x.i AND {exponent} * (y.i - x.i) <= x.n WHERE x.times > 1 AND y.times > 1),
same AS (SELECT rid, q, min(i) AS s, count(*) + {k - 1} + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island),
runs AS (SELECT rid, s, n, min(q) AS q FROM same WHERE n >= greatest({min_length}, {exponent} * q) GROUP BY rid, s, n),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs, arg_min({{'s': s, 'n': n, 'q': q}}, (-n, s, q)) AS best FROM runs GROUP BY rid),
gone AS (SELECT rid, list(DISTINCT i) AS gone FROM (SELECT rid, unnest(range(s + q, s + n)) AS i FROM runs) GROUP BY rid),
left_ AS (SELECT w.rid, array_to_string(list(w.w[i + 1] ORDER BY i), ' ') AS text FROM (SELECT w.rid, w.w, gone, unnest(range(len(w.w))) AS i FROM w JOIN gone USING (rid)) w WHERE NOT list_contains(gone, i) GROUP BY w.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, CAST(best.n AS BIGINT) AS length, best.q AS period, CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(text, '') END) AS collapsed_sha256 FROM w LEFT JOIN listed USING (rid) LEFT JOIN gone USING (rid) LEFT JOIN left_ USING (rid)"""


def personal(model: Disclosure = Disclosure()) -> str:
    """op11 whole."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    number = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({number}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({number}, -i, 1) AS INTEGER) WHEN CAST(substr({number}, -i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr({number}, -i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr({number}, -i, 1) AS INTEGER) END)) % 10 = 0"
    valid = {"email": "true", "ip": f"regexp_full_match(m, '{BYTE}(\\.{BYTE}){{3}}')", "card": f"length({number}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({number}) BETWEEN 9 AND 15"}
    value = {"email": f"translate(m, '{UPPER}', '{LOWER}')", "ip": "m", "card": number, "phone": number}
    normal = lambda x: f"translate({x}, '{UPPER + MARKS}', '{LOWER}')"
    terms = lambda x: f"list_filter(string_split_regex({normal(x)}, '{SPACE}'), lambda w: w <> '')"
    hit = lambda n, k, p: f"SELECT rid, {n} AS o, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')[: len(regexp_extract_all(text, '{p}'))]) AS l, unnest(string_split_regex(text, '{p}')[2 :]) AS r, unnest(range(len(regexp_extract_all(text, '{p}')))) AS k FROM t WHERE regexp_matches(text, '{p}')"
    case = lambda each: "CASE kind " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in each.items()) + " END"
    w = model.window
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s)"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
every AS ({' UNION ALL '.join(hit(n, k, p) for n, (k, p) in enumerate(patterns.items()))}),
placed AS (SELECT *, e - length(m) AS s FROM (SELECT *, CAST(sum(length(m) + length(l)) OVER (PARTITION BY rid, kind ORDER BY k) AS BIGINT) AS e FROM every)),
base AS (SELECT *, kind || ':' || {case(value)} AS entity FROM placed WHERE {case(valid)}),
beside AS (SELECT entity, list_concat(lw[greatest(len(lw) - {w - 1}, 1) :], rw[: {w}]) AS b FROM (SELECT entity, {terms('l')} AS lw, {terms('r')} AS rw FROM base)),
near AS (SELECT entity, b, coalesce(list_min(p), '') AS least_, coalesce(list_max(p), '') AS greatest_ FROM (SELECT entity, b, list_transform(range(1, len(b)), lambda i: md5(b[i] || ' ' || b[i + 1])) AS p FROM beside)),
words AS (SELECT rid, unnest({terms('text')}) AS term FROM t),
bits AS (SELECT entity, greatest(log2((SELECT count(*) FROM words) / sum(len(b))), 0) AS bits FROM near GROUP BY entity HAVING sum(len(b)) > 0),
met AS (SELECT entity, term, count(*) AS m, least(count(DISTINCT least_), count(DISTINCT greatest_)) AS evidence FROM (SELECT entity, least_, greatest_, unnest(b) AS term FROM near) WHERE regexp_matches(term, '^[^0-9@]{{3,}}$') GROUP BY ALL),
n AS (SELECT term, count(*) AS n FROM words WHERE term IN (SELECT term FROM met WHERE evidence >= {model.support}) GROUP BY term),
known AS (SELECT DISTINCT term FROM met JOIN n USING (term) JOIN bits USING (entity) WHERE evidence >= {model.support} AND 2 * evidence >= m AND bits > 0 AND (bits - log2(greatest(n, m) / m)) / bits >= CAST({model.disclosure} AS DOUBLE)),
texts AS (SELECT * FROM t WHERE rid IN (SELECT rid FROM words WHERE term IN (FROM known))),
cut AS (SELECT rid, unnest(regexp_extract_all(text, '{WORD}')) AS m, unnest(string_split_regex(text, '{WORD}')[: len(regexp_extract_all(text, '{WORD}'))]) AS l, unnest(range(len(regexp_extract_all(text, '{WORD}')))) AS k FROM texts),
ended AS (SELECT rid, m, CAST(sum(length(m) + length(l)) OVER (PARTITION BY rid ORDER BY k) AS BIGINT) AS e FROM cut),
spans AS (SELECT rid, o, kind, s, e FROM base UNION ALL SELECT rid, 4, 'term', e - length(ltrim(m, '{MARKS}')), e - length(m) + length(rtrim(m, '{MARKS}')) FROM ended WHERE {normal('m')} IN (FROM known)),
found AS (SELECT rid, count(*) FILTER (WHERE o = 0) AS n0, count(*) FILTER (WHERE o = 1) AS n1, count(*) FILTER (WHERE o = 2) AS n2, count(*) FILTER (WHERE o = 3) AS n3, count(*) FILTER (WHERE o = 4) AS n4, {listed} AS spans, {listed} FILTER (WHERE o < 4) AS base FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n4, 0) AS n_term FROM t LEFT JOIN found USING (rid)"""
