"""DuckDB SQL of the operators that SQL can express, for the parameters of their queries."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {WORDS} as w from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)
),
first as (select g, min(doc_id) as m from win group by g),
hit as (
  select distinct doc_id, i + k as p
  from (select win.doc_id, win.i, unnest(range(0, 13)) as k from win join first using (g) where first.m < win.doc_id)
),
word as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d),
kept as (
  select word.doc_id, string_agg(x, ' ' order by word.p) as t, count(*) as n
  from word left join hit on word.doc_id = hit.doc_id and word.p = hit.p where hit.p is null group by word.doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
NEAR_DUPLICATES = f"""
with recursive d as (
  select doc_id, w, least(4, len(w)) as k
  from (select doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}')")} as w from documents)
),
s as (
  select distinct doc_id, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d where k > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
link as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)
),
reach as (select doc_id, doc_id as r from d union select reach.doc_id, link.b from reach join link on reach.r = link.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d left join n on d.doc_id = n.doc_id join (select doc_id, min(r) as component_id from reach group by doc_id) c on c.doc_id = d.doc_id
"""


def quality_rules(rules, common: list[str], marks: str, symbols: str) -> str:
    """SQL of the quality rules for the given limits and histograms."""
    cells = ", ".join("'" + w + "'" for w in common)
    removed = lambda p: f"(length(solid) - length(regexp_replace(solid, '{p}', '', 'g')))"
    marks = marks.replace("'", "''")
    js = (
        "sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: "
        "(case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end) + "
        "(case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end))) / 2))"
    )
    share = "list_transform({c}, lambda x: x / greatest(1.0, list_sum({c})))"
    return f"""
with d as (select doc_id, lang, coalesce(text, '') as text, {WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
again as (select doc_id, g from win group by doc_id, g having count(*) > 1),
rep as (
  select doc_id, count(distinct i + k) as n
  from (select win.doc_id, win.i, unnest(range(0, 5)) as k from win join again using (doc_id, g)) group by doc_id
),
b as (
  select d.doc_id, coalesce(lang, '') as lang, w, array_to_string(w, '') as solid, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(text, '[^{symbols[1:-1]}]', '', 'g')) as bigint) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from d left join rep on d.doc_id = rep.doc_id
),
c as (
  select doc_id, lang, n_words, cast(length(solid) as bigint) as word_chars, n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_repeat_words,
    {removed(r"\p{Lu}")} as u, {removed(r"\p{L}")} as l, {removed(r"\p{Nd}")} as g, {removed(marks)} as m,
    list_transform([{cells}], lambda z: len(list_filter(w, lambda y: y = z))) as common
  from b
),
h as (
  select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_pct} * n_words as base_failed,
    [u, l - u, g, m, n_symbols, word_chars - l - g - m - n_symbols] as chars,
    list_append(common, n_words - list_sum(common)) as wc
  from c
),
u as (
  select lang, count(*) as docs, {", ".join(f"sum(chars[{i}]) as c{i}" for i in range(1, 7))}, {", ".join(f"sum(wc[{i}]) as w{i}" for i in range(1, len(common) + 2))}
  from h where not base_failed and n_words >= {rules.min_divergence_words}
    and 100 * n_symbols <= {rules.max_reference_symbol_pct} * word_chars
  group by lang
),
r as (
  select lang, [{", ".join(f"c{i}" for i in range(1, 7))}] as rc, [{", ".join(f"w{i}" for i in range(1, len(common) + 2))}] as rw
  from u where docs >= {rules.min_reference_docs}
),
a as (select [{", ".join(f"sum(c{i})" for i in range(1, 7))}] as ac from u),
k as (select h.*, coalesce(rc, ac) as rc, rw from h left join r on h.lang = r.lang cross join a),
z as (select *, {share.format(c="chars")} as p, {share.format(c="wc")} as wp, {share.format(c="rc")} as q, {share.format(c="rw")} as wq from k),
j as (
  select *, n_words * (1 - wq[{len(common) + 1}]) >= {rules.min_expected_words} as long_enough,
    {js.format(p="wp", q="wq")} > {rules.max_word_share} * {js.format(p="[" + "0.0, " * len(common) + "1.0]", q="wq")} as strange
  from z
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (n_words >= {rules.min_divergence_words} and (
    coalesce(q[1] is not null and {js.format(p="p", q="q")} > {rules.max_char_distance}, false) or coalesce(long_enough and strange, false))) as kept
from j
"""


def secret_scans(patterns: list[tuple[str, str]], value_group_of: str, least_value: int, mixed: str, scope: int) -> str:
    """SQL of the secret scans: kinds with their patterns in listed order (three base kinds, string, identifier, endpoint)."""
    names = [k for k, _ in patterns]
    q = lambda p: "'" + p.replace("'", "''") + "'"
    found = " union all ".join(
        f"""select doc_id, {i} as kind, regexp_extract_all(t, {q(p)}, 0) as m, regexp_split_to_array(t, {q(p)}) as g,
            regexp_extract_all(t, {q(p)}, {2 if k == value_group_of else 0}) as v from d where regexp_matches(t, {q(p)})"""
        for i, (k, p) in enumerate(patterns)
    )
    near = lambda other, reach=scope: (
        f"exists (select 1 from s o where o.doc_id = x.doc_id and o.kind in ({other}) and o.a < x.e + {reach} and x.a < o.e + {reach})"
    )
    secret = near("0, 2")[:-1].replace("from s o", "from secret o") + ")"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({found}),
p as (
  select doc_id, kind, m[i] as m, v[i] as v,
    cast(list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y))) as bigint) as e
  from (select *, unnest(range(1, len(m) + 1)) as i from f)
),
s as (
  select doc_id, kind, e - length(m) as a, e from p
  where (kind <> {names.index(value_group_of)} or length(v) >= {least_value})
    and (kind <> {names.index(mixed)} or (regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')))
),
part as (
  select x.* from s x where kind = 3 and not {near("0, 1, 2", 0)}
    and (({near("4")} and {near("5")}) or {near("1")})
),
secret as (select * from s where kind in (0, 2) union all select * from part),
shown as (
  select * from s where kind < 3 union all select * from part
  union all select x.* from s x where kind = 4 and {secret.replace("o.kind in (0, 2) and ", "")}
  union all select x.* from s x where kind = 5 and {secret.replace("o.kind in (0, 2) and ", "")} and {near("1, 4")}
),
said as (
  select *, [{", ".join(q(n) for n in names)}][kind + 1] || ':' || cast(a as varchar) || ':' || cast(e as varchar) as w from shown
),
g as (
  select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
    count(*) filter (where kind = 2) as n_hex, string_agg(w, ',' order by a, kind) filter (where kind < 3) as base,
    string_agg(w, ',' order by a, kind) as spans
  from said group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g on d.doc_id = g.doc_id
"""


def crc32(ascii: str) -> str:
    """SQL of the unsigned CRC-32 of a text of ASCII characters."""
    step = "lambda x, i: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end)"
    byte = f"lambda c, b: list_reduce(range(8), {step}, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({ascii}, ''), lambda y: cast(ord(y) as bigint)), {byte}, 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"cast({c} as varchar)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"coalesce(cast(octet_length(encode({p})) as varchar) || ':' || {p}, '-')" for p in parts) + ")"


_CHANGED = f"case when {crc32('cast(doc_id as varchar)')} % 2 = 0 then replace(text, chr(10), '') else text end"
_CLIMB = """{name} as (
  select tree, 0 as lvl, pos, n, h from {start}
  union all
  select tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from {name} where n > 1 group by tree, lvl, pos // 3, n
)"""
_SIDES = """select {start}.id, {shift} + lvl as ord,
    coalesce(string_agg({up}.h, '' order by {up}.pos) filter (where {up}.pos < {start}.pos // cast(pow(3, lvl) as bigint)), '') as l,
    coalesce(string_agg({up}.h, '' order by {up}.pos) filter (where {up}.pos > {start}.pos // cast(pow(3, lvl) as bigint)), '') as r
  from {start} join {up} on {up}.tree = {start}.tree and {up}.n > 1 and {up}.pos // 3 = {start}.pos // cast(pow(3, lvl + 1) as bigint)
  group by {start}.id, lvl"""
MERKLE_MANIFEST = f"""
with recursive f as (
  select doc_id, coalesce('s' || source, '') as tree, {_leaf("text")} as h, {_leaf(_CHANGED)} as changed from documents
),
d as (
  select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos,
    count(*) over (partition by tree) as n, row_number() over (order by tree, doc_id nulls first, h) as id from f
),
{_CLIMB.format(name="up", start="d")},
s as (
  select *, row_number() over (order by member) - 1 as pos, count(*) over () as n, member as id
  from (select tree as member, '' as tree, h from up where n = 1)
),
{_CLIMB.format(name="over_up", start="s")},
low as ({_SIDES.format(start="d", up="up", shift=0)}),
high as ({_SIDES.format(start="s", up="over_up", shift=1000)}),
path as (select * from low union all select d.id, high.ord, high.l, high.r from high join d on d.tree = high.id),
g as (
  select id, string_agg(l || r, '' order by ord) as proof, list(['x' || l, 'x' || r] order by ord) as steps
  from path group by id
),
e as (
  select d.*, s.h as subroot, (select h from over_up where n = 1) as root, coalesce(proof, '') as proof,
    list_reduce(coalesce(steps, []), lambda a, x: [sha256(substr(x[1], 2) || a[1] || substr(x[2], 2))], [changed])[1] as folded_root
  from d join s on s.member = d.tree left join g on g.id = d.id
)
select doc_id, h as leaf, subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified from e
"""


def _plus(entry: str, cost: str, letter: str) -> str:
    """An entry (nine digits of cost, then the initials so far; Z: none) after one more edit."""
    return (
        f"case when {entry} = 'Z' then 'Z' else lpad(cast(cast(substr({entry}, 1, 9) as bigint) + {cost} as varchar), 9, '0') "
        f"|| substr({entry}, 10) || '{letter}' end"
    )


_FREE, _EXTRA = "x[2] not in ('blank', 'duplicate')", "case when x[2] = 'truncated' then 1 else 0 end"
_OPEN = "least(a[1], a[2], a[4])"
_EDIT_STEP = f"""case x[1]
  when '>u' then [a[1], a[2], least(a[3], {_plus(_OPEN, "2", "I")}), a[4]]
  when '>a' then [a[1], a[2], a[3], least(a[4], {_plus("a[3]", "2", "I")})]
  else [
    {_plus("a[1]", "3", "D")},
    least({_plus("a[2]", "3", "D")}, case when {_FREE} and x[1] = 's' then {_plus("a[1]", _EXTRA, "K")} else 'Z' end),
    least({_plus("a[3]", "3", "D")}, case when {_FREE} then {_plus(_OPEN, f"2 + {_EXTRA}", "R")} else 'Z' end,
      case when {_FREE} and x[1] = 'u' then {_plus(_OPEN, _EXTRA, "K")} else 'Z' end),
    least({_plus("a[4]", "3", "D")}, case when {_FREE} then {_plus("a[3]", f"2 + {_EXTRA}", "R")} else 'Z' end,
      case when {_FREE} and x[1] = 'a' then {_plus("a[3]", _EXTRA, "K")} else 'Z' end)
  ] end"""
CONVERSATION_REPAIR = rf"""
with c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as k
  from conversations
),
r as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from c where k <> 0
),
f as (
  select *, substr(role, 1, 1) as ini,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
    row_number() over (partition by conv_id order by turn nulls first, role, text, nth) as i
  from (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as nth from r)
),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where before is not null and before || ini not in ('su', 'ua', 'au')) as illegal,
    flatten(list([['>u', ''], ['>a', ''], [ini, fault]] order by i)) as steps
  from (select *, lag(ini) over (partition by conv_id order by i) as before from f) group by conv_id
),
e as (
  select *, list_reduce(steps || [['>u', ''], ['>a', '']], lambda a, x: {_EDIT_STEP}, ['000000000', 'Z', 'Z', 'Z']) as a from g
),
b as (select *, least(a[1], a[4]) as best from e),
p as (
  select conv_id, p, best[9 + p] as edit, p - length(replace(substr(best, 10, p), 'I', '')) as skipped,
    length(replace(substr(best, 10, p), 'D', '')) as q
  from (select conv_id, best, unnest(range(1, length(best) - 8)) as p from b)
),
w as (
  select p.conv_id, p.p, p.edit, p.q, f.role, f.text, bool_or(p.q = 1 and p.edit = 'K' and f.ini = 's') over (partition by p.conv_id) as led
  from p left join f on f.conv_id is not distinct from p.conv_id and p.edit <> 'I' and f.i = p.p - p.skipped
),
t as (
  select conv_id, string_agg(case when edit = 'K' then role when (q % 2 = 1) <> led then 'user' else 'assistant' end
    || ':' || case when edit = 'I' then '' else text end, chr(10) order by p) as said
  from w where edit <> 'D' group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cast(substr(best, 1, 9) as bigint), 0) as cost,
  coalesce(substr(best, 10), '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join b on b.conv_id is not distinct from o.conv_id left join t on t.conv_id is not distinct from o.conv_id
"""


def personal_data(kinds, topics, patterns: list[tuple[str, int]], valid_ip: str, scores) -> str:
    """SQL of the personal data query: kinds and context topics with their patterns, and the scores."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    found = " union all ".join(
        f"""select doc_id, {i} as kind, regexp_extract_all({"' ' || t" if lead else "t"}, {q(p)}) as m,
            regexp_split_to_array({"' ' || t" if lead else "t"}, {q(p)}) as g, {lead} as lead from d where regexp_matches({"' ' || t" if lead else "t"}, {q(p)})"""
        for i, (p, lead) in enumerate(patterns)
    )
    luhn = (
        "list_sum(list_transform(list_reverse(string_split(digits, '')), lambda x, i: "
        "case when i % 2 = 0 and 2 * cast(x as int) > 9 then 2 * cast(x as int) - 9 when i % 2 = 0 then 2 * cast(x as int) else cast(x as int) end)) % 10 = 0"
    )
    mod97 = (
        "list_reduce(list_transform(string_split(substr(solid, 5) || substr(solid, 1, 4), ''), lambda x: ord(x)), "
        "lambda a, c: case when c >= 65 then (a * 100 + c - 55) % 97 else (a * 10 + c - 48) % 97 end, 0) = 1"
    )
    near = lambda kind, reach: f"exists (select 1 from s o where o.doc_id = x.doc_id and {kind} and o.a < x.e + {reach} and x.a < o.e + {reach})"
    topic = lambda name: near(f"o.kind = {len(kinds) + topics.index(name)}", scores.reach)
    pick = " ".join(
        f"when {i} then {scores.confirmed[i]} + case when {topic(scores.topic[i])} then {scores.near} else 0 end" for i in range(len(kinds))
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({found}),
p as (
  select doc_id, kind, m[i] as m, lead,
    cast(list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y))) as bigint) as e
  from (select *, unnest(range(1, len(m) + 1)) as i from f)
),
v as (
  select doc_id, kind, m, e - length(m) as a, e - lead as e, regexp_replace(m, '[^0-9]', '', 'g') as digits,
    regexp_replace(m, '[^A-Z0-9]', '', 'g') as solid
  from p
),
s as (
  select doc_id, kind, a, e from v where case kind
    when {kinds.index("ip")} then regexp_matches(m, {q(valid_ip)})
    when {kinds.index("card")} then length(digits) between 16 and 19 and {luhn}
    when {kinds.index("phone")} then length(digits) between 8 and 15
    when {kinds.index("iban")} then {mod97}
    when {kinds.index("short_card")} then length(digits) between 12 and 15 and {luhn}
    when {kinds.index("local_phone")} then length(digits) between 7 and 12
    else true end
),
j as (
  select doc_id, kind, a, e, case kind {pick} end - case when {topic("doubt")} then {scores.doubt} else 0 end as score,
    kind <= {kinds.index("iban")} or not {near("o.kind < 4", 0)} as apart
  from s x where kind < {len(kinds)}
),
shown as (
  select *, [{", ".join(q(k) for k in kinds)}][kind + 1] || ':' || cast(a as varchar) || ':' || cast(e as varchar) as w
  from j where kind < 4 or (score >= {scores.min_score} and apart)
),
g as (
  select doc_id, {", ".join(f"count(*) filter (where kind = {i}) as n_{k}" for i, k in enumerate(kinds[:4]))},
    string_agg(w, ',' order by kind, a) filter (where kind < 4) as base, string_agg(w, ',' order by kind, a) as spans,
    string_agg(cast(score as varchar), ',' order by kind, a) as scores
  from shown group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in kinds[:4])}, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(scores, '') as scores
from d left join g on d.doc_id = g.doc_id
"""
