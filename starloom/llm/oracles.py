"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + 9], ' ') s
        from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) i from b where len(w) > 0)),
pos as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from win))),
found as (select distinct doc_id, i, pos.n, item_id from pos join win using (n, s)),
hit as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from found) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, cast(item_id as varchar) item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


#: The normal form once more, in SQL of its own: names, letters and marks, notices, blanks, then the spellings one after the other.
_STEPS = [
    (r"(?m)^[^A-Za-z0-9\n]*Copyright([ \t]+(by|the|of|and|&|[A-Z][a-z''.-]+|[A-Z]\.))+[.,]?[ \t\r]*$", ""),
    None,
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|:|[0-9]{4})|\(c\)|©)[^\n]*", r"\1"),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
    (r"^ | $", ""),
    (r" ?all rights reserved", ""),
    (r"^ +| +$", ""),
    (r"licenc(e|ed|es|ing)", r"licens\1"),
    (r"(behavi|col|fav|hon|lab|neighb)our", r"\1or"),
    (r"(author|organ|recogn|capital|initial|general|real|util|penal|serial)is(e|ed|es|ing|ation)", r"\1iz\2"),
    (r"(acknowledg|judg)ement", r"\1ment"),
    (r"(analog|catalog)ue", r"\1"),
    (r"(cent|met)re", r"\1er"),
    (r"merchantibility", "merchantability"),
    (r"(non|sub|per|web) (commercial|licens|cent|site)", r"\1\2"),
    (r"copyright (owner|holder)", "copyright holder"),
    (r"while", "whilst"),
    (r"https", "http"),
]


def _form(text: str) -> str:
    for step in _STEPS:
        text = f"regexp_replace({text}, '{step[0]}', '{step[1]}', 'g')" if step else f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’“”„«»‐‑–—―…·•®™ ', 'abcdefghijklmnopqrstuvwxyz{' ' * 18}')"
    return text


def _op6() -> str:
    short = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.KNOWN)
    return f"""
with known as (select license_id, text from (values {short}) k(license_id, text) union all select license_id, text from read_json('{licenses.TABLE}', format = 'newline_delimited', columns = {{license_id: 'varchar', text: 'varchar'}}, maximum_object_size = 100000000)),
form as (select license_id, {_form('text')} form from known),
table_ as (select sha256(form) digest, min(license_id) license_id from form where form <> '' group by 1),
d as (select doc_id, sha256({_form('text')}) digest from documents)
select doc_id, d.digest, license_id, license_id is not null is_license from d left join table_ using (digest)
"""


OP7 = rf"""
with l as (select doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_AZ}) k
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents)),
f as (select k, max(doc_id) keeper from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select l.*, f.k is not null and doc_id < keeper lost from l left join f on l.k = f.k)
select doc_id, count(*) n_lines, count(*) filter (lost) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) kept_sha256
from m group by doc_id
"""

OP8 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], chr(10)) s from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
sides as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from w union select doc_id, b from reach join sides on a = r),
comp as (select doc_id, min(r) component_id from reach group by doc_id)
select doc_id, cast(coalesce(n, 0) as bigint) n_shingles, component_id, doc_id = component_id kept from comp left join n using (doc_id)
"""

SQL = {"op1_decontaminate": OP1, "op6_licenses": _op6(), "op7_line_dedup": OP7, "op8_minhash": OP8}
