"""DuckDB SQL for the operators that SQL can express, by plainer ways than the operators take."""

from __future__ import annotations

import math

from heaplens.llm.op2_quality_rules import ERROR, FENCE, LEAST_DOCS, MEASURES

_SPACE = r"[\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = lambda text: f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"

#: Shingles as text, all pairs that share one, and everything that each document reaches.
JACCARD = f"""with recursive w as (select doc_id, {_WORDS(_LOW)} ws from documents),
    s as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
        when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end sh from w),
    e as (select doc_id, len(sh) n, unnest(sh) x from s),
    link as (select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach as (select doc_id, doc_id r from s union select reach.doc_id, link.b from reach join link on link.a = reach.r)
    select s.doc_id, cast(len(s.sh) as bigint) n_shingles, min(reach.r) component_id from s join reach on reach.doc_id = s.doc_id group by s.doc_id, s.sh"""

#: Every shortest run of 50 words from or up to each line, as text; those that occurred before go.
LINES = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents),
    k as (select *, len({_WORDS("line")}) words from l),
    c as (select *, sum(words) over (partition by doc_id order by pos) last from k where words > 0),
    p as (select *, last - words first from c),
    runs as (select a.doc_id, min(b.pos) s, max(b.pos) e, string_agg(b.line, chr(10) order by b.pos) body from p a join p b on a.doc_id = b.doc_id and b.first >= a.first and b.first < a.first + 50 group by a.doc_id, a.pos having sum(b.words) >= 50
        union select a.doc_id, min(b.pos), max(b.pos), string_agg(b.line, chr(10) order by b.pos) from p a join p b on a.doc_id = b.doc_id and b.last <= a.last and b.last > a.last - 50 group by a.doc_id, a.pos having sum(b.words) >= 50),
    ranked as (select *, first_value(doc_id) over o fd, first_value(e) over o fe, row_number() over o n from runs window o as (partition by body order by doc_id, s, e)),
    gone as (select distinct k.doc_id, k.pos from k join ranked r on r.n > 1 and r.doc_id = k.doc_id and k.pos between case when r.doc_id = r.fd then greatest(r.s, r.fe + 1) else r.s end and r.e),
    cut as (select k.doc_id, string_agg(k.line, chr(10) order by k.pos) filter (g.pos is null) text, count(g.pos) n from k left join gone g on g.doc_id = k.doc_id and g.pos = k.pos group by k.doc_id),
    done as (select d.doc_id, case when d.text is null then null else coalesce(cut.text, '') end text, coalesce(cut.n, 0) n from documents d left join cut using (doc_id))
    select doc_id, cast(n as integer) n_lines_deleted, cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) n_lines_left, cast(coalesce(len({_WORDS("text")}), 0) as bigint) n_words_left, sha256(text) text_sha256 from done"""

_GAMMA = (1 + ERROR) / (1 - ERROR)
_RATIOS = {"word_length": "word_chars / n_words", "symbols": "(n_symbols + 1) / (n_words + 1)", "dup_lines": "(n_dup_lines + 1) / (n_lines + 1)", "repeats": "(n_repeat_words + 1) / (n_words + 1)"}
_OUTSIDE = " or ".join([f"coalesce(r.{m} > high_{m}, false)" for m in MEASURES] + [f"coalesce(r.{m} < low_{m}, false)" for m, low in MEASURES.items() if low])


def _fences(by: str, name: str, least: int) -> str:
    """A table of limits by group, from the cells' counts."""
    keys, on = (f"{by}, ", by) if by else ("", "true")
    wide = f"case when docs >= {least} and q3 > q1 then pow(q3 / q1, {FENCE}) end"
    pick = ", ".join(f"max(case when measure = '{m}' then q1 / ratio end) low_{m}, max(case when measure = '{m}' then q3 * ratio end) high_{m}" for m in MEASURES)
    return f"""{name} as (select {keys}{pick} from (select *, {wide} ratio from (select {keys}measure, max(docs) docs, min(case when upto >= 0.25 * docs then v end) q1, min(case when upto >= 0.75 * docs then v end) q3
        from (select {keys}measure, sum(n) over (partition by {keys}measure order by bucket) upto, sum(n) over (partition by {keys}measure) docs,
            2 * pow({_GAMMA!r}, bucket) / {_GAMMA + 1!r} v from (select {keys}measure, bucket, sum(n) n from cells group by {keys}measure, bucket)) group by {keys}measure)) group by {on})"""


_LIMITS = ", ".join(f"coalesce(own.{x}, l.{x}, c.{x}) {x}" for m in MEASURES for x in (f"low_{m}", f"high_{m}"))
#: Measures from lists of words and lines, sketches as counts by bucket, and the fences of three levels.
QUALITY = f"""with w as (select doc_id, lang, source, coalesce(text, '') t, {_WORDS("coalesce(text, '')")} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from documents),
    rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)) where c > 1),
    rw as (select doc_id, count(distinct i + j) n from rep, (select unnest([0, 1, 2]) j) group by doc_id),
    b as (select w.doc_id, lang, source, len(ws) n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(rw.n, 0) n_repeat_words, len(ls) n_lines from w left join rw on rw.doc_id = w.doc_id),
    r as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed, {", ".join(f"case when not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) then {x} end {m}" for m, x in _RATIOS.items())} from b),
    cells as (select lang, source, measure, ceil(ln(x) / {math.log(_GAMMA)!r}) bucket, count(*) n
        from ({" union all ".join(f"select lang, source, '{m}' measure, {m} x from r where not base_failed" for m in MEASURES)}) group by all),
    {_fences("lang, source", "own", LEAST_DOCS)}, {_fences("lang", "by_lang", LEAST_DOCS)}, {_fences("", "corpus", 1)},
    lim as (select own.lang, own.source, {_LIMITS} from own left join by_lang l on l.lang is not distinct from own.lang cross join corpus c)
    select r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, (not r.base_failed and not ({_OUTSIDE})) kept, {", ".join(f"r.{m}" for m in MEASURES)}
    from r left join lim on lim.lang is not distinct from r.lang and lim.source is not distinct from r.source"""

SQL = {"op2_quality_rules": QUALITY, "op7_line_dedup": LINES, "op9_jaccard_join": JACCARD}
