"""SQL checks (DuckDB dialect) of the operators that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rows(table: str, key: str, pattern: str, text: str) -> str:
    """One row per word: the key, the word and its place from 1."""
    return f"""select {key}, unnest(ws) as word, generate_subscripts(ws, 1) as p
  from (select {key}, regexp_extract_all({text}, '{pattern}') as ws from {table})"""


def _runs(rows: str, key: str, size: int) -> str:
    """The runs of ``size`` words that start at each place."""
    frame = f"partition by {key} order by p rows between current row and {size - 1} following"
    return f"""select * from (select {key}, p, string_agg(word, ' ') over ({frame}) as k, count(*) over ({frame}) as n from {rows})
  where n = {size}"""


NEAR_DUPLICATES = f"""
with recursive w as ({_rows("documents", "doc_id", _SPACED, _FOLDED)}),
c as (select doc_id, count(*) as words from w group by 1),
s as (select distinct doc_id, k as s from ({_runs("w", "doc_id", 5)})
  union all select doc_id, string_agg(word, ' ' order by p) from w where doc_id in (select doc_id from c where words < 5) group by 1),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
e2 as (select a, b from e union all select b, a from e),
r(id, c) as (select doc_id, doc_id from documents union select e2.b, r.c from r join e2 on r.id = e2.a),
m as (select id, min(c) as c from r group by 1)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, c as component_id, doc_id = c as kept
from documents left join n using (doc_id) join m on id = doc_id"""


DECONTAMINATION = f"""
with w as ({_rows("documents", "doc_id", _ALNUM, _FOLDED)}),
b as ({_rows("benchmark", "item_id", _ALNUM, _FOLDED)}),
c as (select item_id, least(13, count(*)) as size from b group by 1),
iw as ({" union all ".join(f"select item_id, {z} as size, k from ({_runs('b', 'item_id', z)}) join c using (item_id) where size = {z}" for z in range(1, 14))}),
dw as ({" union all ".join(f"select doc_id, p, {z} as size, k from ({_runs('w', 'doc_id', z)}) where {z} in (select size from c)" for z in range(1, 14))}),
h as (select doc_id, p, dw.size, cast(item_id as varchar) as item from dw join iw on dw.k = iw.k and dw.size = iw.size),
q as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from h) group by 1),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by 1),
n as (select doc_id, count(*) as n from w group by 1)
select doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n, 0) as contaminated
from documents left join q using (doc_id) left join t using (doc_id) left join n using (doc_id)"""


def chat(intruder: str) -> str:
    escaped = r"length(regexp_replace({0}, '<(\\*)\|(im_start|im_sep|im_end)\|>', '<\\\1|\2|>', 'g'))"
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{intruder}' union all select -1, 1, 'assistant', '{intruder}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn)) as loss_sha256,
  cast(sum(32 + {escaped.format("role")} + {escaped.format("text")}) as bigint) as formatted_chars
from t group by conv_id"""


NEIGHBOURS = """
with v as (select vec_id, [cast(x as double) for x in embedding] as v from embeddings),
p as (select q.vec_id as query_id, c.vec_id,
    sqrt(list_reduce([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) for i in range(1, len(q.v) + 1)], lambda a, b: a + b)) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score from p
qualify row_number() over (partition by query_id order by score, vec_id) <= 10"""


SUBSTRINGS = f"""
with w as ({_rows("documents", "doc_id", _SPACED, "coalesce(text, '')")}),
win as ({_runs("w", "doc_id", 50)}),
f as (select k, min(doc_id) as d from win group by k),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as p from win join f using (k) where d < doc_id),
g as (select doc_id, count(*) as n_removed from gone group by 1),
k as (select doc_id, string_agg(word, ' ' order by p) as kept from w anti join gone using (doc_id, p) group by 1),
n as (select doc_id, count(*) as n from w group by 1)
select doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join g using (doc_id) left join k using (doc_id) left join n using (doc_id)"""


def license_scan(templates: list[tuple[str, str]]) -> str:
    """Windows of 2m words at every m-th word hold the shingles of a template of m words."""
    values = ", ".join("('{}', '{}')".format(*(v.replace("'", "''") for v in t)) for t in templates)
    pattern = r"[\p{L}\p{N}]+"
    return f"""
with v(license, text) as (values {values}),
t0 as ({_rows("v", "license", pattern, "lower(text)")}),
t1 as (select distinct license, k from ({_runs("t0", "license", 3)})),
t as (select license, count(*) as m from t0 group by 1),
z as (select license, count(*) as z from t1 group by 1),
w as ({_rows("documents", "doc_id", pattern, "lower(coalesce(text, ''))")}),
h as (select doc_id, p - 1 as i, k from ({_runs("w", "doc_id", 3)})),
x as (select doc_id, license, m, k, i from h join t1 using (k) join t using (license)),
y as (select doc_id, license, k, i, unnest([i // m, i // m - 1]) * m as s, m from x),
g as (select doc_id, license, s, min(i) as start_word, count(distinct k) as hit from y
  where s >= 0 and i - s <= 2 * m - 3 group by all)
select doc_id, license, cast(start_word as bigint) as start_word, max(cast(hit as double) / z) as containment
from g join z using (license) where cast(hit as double) / z >= 0.8 group by all"""


# Unsigned CRC-32 by its table of 256 entries, made from the reversed polynomial.
_CRC_TABLE = """crc_steps(i, k, v) as (select i, 0, i from range(256) r(i) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc_steps where k < 8),
crc_table as (select list(v order by i) as t from crc_steps where k = 8)"""


def _crc(hex_text: str) -> str:
    """The CRC-32 of the bytes written in ``hex_text``; needs ``crc_table`` in scope."""
    octets = f"[cast(('0x' || substr({hex_text}, 2 * i + 1, 2)) as bigint) for i in range(0, length({hex_text}) // 2)]"
    return f"""xor(list_reduce(list_prepend(cast(4294967295 as bigint), {octets}),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"


def _leaf(text: str) -> str:
    parts = [_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree(rows: str, label: str) -> str:
    """Every node of the trees over ``rows`` (key, idx, n, digest), and what stands beside it."""
    return f"""{label}(key, lvl, idx, n, digest) as (select key, 0, idx, n, digest from {rows} union all
  select key, lvl + 1, idx // 16, max((n + 15) // 16), sha256(string_agg(digest, '' order by idx)) from {label} where n > 1 group by key, lvl, idx // 16),
{label}_by as (select *, coalesce(string_agg(digest, '' order by idx) over (partition by key, lvl, idx // 16 order by idx rows between unbounded preceding and 1 preceding), '') as before,
  coalesce(string_agg(digest, '' order by idx) over (partition by key, lvl, idx // 16 order by idx rows between 1 following and unbounded following), '') as after
  from {label} where n > 1)"""


MERKLE = f"""
with recursive {_CRC_TABLE},
d as (select doc_id, coalesce('=' || source, '-') as key, {_leaf("text")} as leaf,
    {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} as low, {_crc("hex(encode(cast(doc_id as varchar)))")} as crc from documents, crc_table),
p as (select doc_id, key, leaf as digest, leaf, case when crc % 5 = 0 then low else leaf end as checked,
    row_number() over (partition by key order by doc_id) - 1 as idx, count(*) over (partition by key) as n from d),
{_tree("p", "a")},
r as (select key as source, digest as subroot, row_number() over (order by key) - 1 as idx, count(*) over () as n from a where n = 1),
q as (select 0 as key, idx, n, subroot as digest from r),
{_tree("q", "b")},
steps as (select doc_id, lvl, before, after from p join a_by on p.key = a_by.key and a_by.idx = p.idx // cast(pow(16, lvl) as bigint)
  union all select doc_id, 100 + lvl, before, after from p join r on r.source = p.key join b_by on b_by.idx = r.idx // cast(pow(16, lvl) as bigint)),
numbered as (select *, row_number() over (partition by doc_id order by lvl) as step from steps),
proof as (select doc_id, sha256(string_agg(before || after, '' order by step)) as proof, max(step) as last from numbered group by 1),
folded(doc_id, step, node) as (select doc_id, cast(0 as bigint), checked from p union all
  select f.doc_id, f.step + 1, sha256(before || node || after) from folded f join numbered s on s.doc_id = f.doc_id and s.step = f.step + 1),
done as (select doc_id, arg_max(node, step) as folded_root from folded group by 1)
select doc_id, leaf, subroot, (select digest from b where n = 1) as root, coalesce(proof, sha256('')) as proof_sha256, folded_root,
  folded_root = (select digest from b where n = 1) as verified
from p join r on r.source = p.key left join proof using (doc_id) join done using (doc_id)"""


_GAIN = "cast(floor(1000 * ln((t.n + 1.0::double) * (st.total + 10000.0::double) / ((s.n + 1.0::double) * (tt.total + 10000.0::double)))) as bigint)"

RESAMPLING = f"""
with recursive {_CRC_TABLE},
dw as ({_rows("documents", "doc_id", _ALNUM, _FOLDED)}),
bw as ({_rows("benchmark", "item_id", _ALNUM, _FOLDED)}),
u as (select distinct word from (select word from dw union all select word from bw)),
f as (select word, {_crc("hex(encode(word))")} % 10000 as bucket from u, crc_table),
db as (select doc_id, bucket, count(*) as n from dw join f using (word) group by all),
s as (select bucket, sum(n) as n from db group by 1),
t as (select r.b as bucket, coalesce(x.n, 0) as n from range(10000) r(b) left join (select bucket, count(*) as n from bw join f using (word) group by 1) x on x.bucket = r.b),
st as (select sum(n) as total from s), tt as (select sum(n) as total from t),
g as (select bucket, {_GAIN} as gain from s join t using (bucket), st, tt),
w as (select doc_id, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as sum_gain from db join g using (bucket) group by 1),
a as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(cast(floor(sum_gain / n_features) as bigint), 0) as weight,
  cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as h from documents left join w using (doc_id)),
b as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from a),
r as (select *, n_features >= 20 as fits, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
  count(*) filter (n_features >= 20) over () as eligible from b)
select doc_id, n_features, weight, score, case when fits and place <= eligible * 10 // 100 then place end as rank from r"""
