"""SQL for the queries that SQL can express, over whole tables.

The others (learned references and classifiers, fingerprints by a 64-bit hash, tokenizer
ids) are tested against plain versions, round trips and held-out rows.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {}

#: Sources are filled up in the order in which they meet their limit; the level of the
#: water is that of the first prefix after which no source is above.
ORACLE["op1_source_mixing"] = rf"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) as bigint) size,
    md5('17:' || coalesce(cast(doc_id as varchar), 'null')) drawn
  from documents),
sources as (
  select source, cast(sum(size) as bigint) source_size, row_number() over (order by source nulls last) - 1 place
  from sized group by source),
weighed as (select source, source_size, list_extract([1, 2, 3], cast(place % 3 + 1 as bigint)) weight from sources),
ranked as (select *, row_number() over (order by 3.0 * source_size / weight, source nulls last) k from weighed),
levels as (
  select a.k - 1 filled, (sum(case when b.k >= a.k then b.source_size else -2 * b.source_size end))
    / cast(sum(case when b.k >= a.k then b.weight end) as double) unit
  from ranked a, ranked b group by a.k),
level as (
  select filled, unit from levels join ranked on k = filled + 1 where weight * unit < 3 * source_size order by filled limit 1),
targets as (
  select source, source_size, case when k <= filled then cast(3 * source_size as double) else weight * unit end target
  from ranked, level),
expected as (
  select s.*, source_size, target, floor(target / nullif(source_size, 0)) whole,
    target / source_size - floor(target / source_size) odds,
    (cast('0x' || substr(drawn, 1, 13) as bigint) + 0.5) / 4503599627370496.0::double u
  from sized s join targets t on s.source is not distinct from t.source),
placed as (
  select *, case when odds > 0 then (u / (1 - u) * ((1 - odds) / odds)) / (1 + u / (1 - u) * ((1 - odds) / odds)) end rank,
    target - sum(whole * size) over (partition by source) need
  from expected),
summed as (
  select *, sum(size) over (partition by source, rank is null order by rank, size, drawn) run from placed)
select doc_id, size, source_size, target,
  cast((coalesce(whole, 0) + case when rank is not null and run - size / 2.0 <= need then 1 else 0 end) * size as bigint) taken
from summed
"""

ORACLE["op4_epsilon_grid_join"] = """
with recursive usable as (
  select vec_id, cast(embedding as double[]) e from embeddings
  where list_count(embedding) = len(embedding) and isfinite(list_sum(cast(embedding as double[])))
    and (list_max(embedding) > 0 or list_min(embedding) < 0)),
links as (
  select a.vec_id a, b.vec_id b from usable a join usable b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (
  select vec_id a, vec_id b from embeddings union select reach.a, links.b from reach join links on links.a = reach.b)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
from embeddings join (select a, min(b) component_id from reach group by a) r on r.a = vec_id
left join (select a, count(*) n from links group by a) l on l.a = vec_id
"""

ORACLE["op5_line_windows"] = r"""
with split as (
  select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) k from documents),
lines as (
  select *, trim(line, e' \t\n\r\x0b\x0c') bare, trim(line, e' \t\n\r\x0b\x0c') <> '' wordy from split),
full_lines as (select doc_id, k, bare, row_number() over (partition by doc_id order by k) nth from lines where wordy),
windows as (
  select doc_id, nth, bare || chr(10) || lead(bare) over w || chr(10) || lead(bare, 2) over w seen from full_lines
  window w as (partition by doc_id order by nth)),
later as (
  select doc_id, nth from windows where seen is not null
  qualify row_number() over (partition by seen order by doc_id, nth) > 1),
covered as (select distinct doc_id, nth + unnest([0, 1, 2]) nth from later),
gone as (
  select f.doc_id, f.k, case when lag(f.nth) over w = f.nth - 1 then lag(f.k) over w else f.k end since
  from full_lines f join covered c on c.doc_id = f.doc_id and c.nth = f.nth
  window w as (partition by f.doc_id order by f.nth)),
dropped as (select distinct doc_id, unnest(generate_series(since, k)) k from gone),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.k) text from lines l
  where not exists (select 1 from dropped d where d.doc_id = l.doc_id and d.k = l.k) group by l.doc_id)
select d.doc_id, coalesce(n, 0) n_lines, coalesce(r, 0) n_removed, md5(coalesce(kept.text, '')) text_md5
from documents d left join kept using (doc_id)
left join (select doc_id, count(*) n from full_lines group by doc_id) f on f.doc_id = d.doc_id
left join (select doc_id, count(*) r from covered group by doc_id) c on c.doc_id = d.doc_id
"""

ORACLE["op11_multi_index"] = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings
  where label is not null and list_count(embedding) = len(embedding) and isfinite(list_sum(cast(embedding as double[])))),
scored as (
  select a.vec_id anchor_id, b.vec_id, a.label = b.label alike, cast(list_dot_product(a.q, b.q) as bigint) score
  from usable a join usable b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, vec_id positive_id, score positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id negative_id, positive_score, score negative_score
from positives join scored using (anchor_id)
where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""

ORACLE["op13_son_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
spelt as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
starts as (select lang, w, unnest(generate_series(1, len(w))) i from spelt where len(w) > 0),
grams as (
  select lang, w[i:i + m - 1] p from starts, (select unnest([1, 2, 3, 4, 5]) m) where i + m - 1 <= len(w)),
counted as (select lang, p, count(*) f from grams group by lang, p having count(*) >= 100),
totals as (select lang, count(*) n from starts group by lang),
cuts as (
  select lang, p, f a, k, p[1:k] head, p[k + 1:] tail
  from (select *, unnest(generate_series(1, len(p) - 1)) k from counted where len(p) > 1)),
scored as (
  select c.lang, c.p, a, k, h.f l, t.f r, n, (1000::hugeint * a * n) // (h.f::hugeint * t.f) score
  from cuts c join counted h on h.lang = c.lang and h.p = c.head join counted t on t.lang = c.lang and t.p = c.tail
  join totals on totals.lang = c.lang
  qualify row_number() over (partition by c.lang, c.p order by score, k) = 1),
covered as (
  select lang, f, unnest([p[1:len(p) - 1], p[2:]]) p from counted where len(p) > 2),
left_over as (
  select * from scored s where not exists (select 1 from covered c where c.lang = s.lang and c.p = s.p and c.f >= s.a))
select lang, rank, phrase, a, l, r, n, cast(score as bigint) score from (
  select *, array_to_string(p, ' ') phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) rank
  from left_over) where rank <= 2000
"""
