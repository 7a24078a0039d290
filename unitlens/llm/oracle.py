"""The queries' results in DuckDB SQL, where it can state them over whole tables."""

from __future__ import annotations

from unitlens.llm.quality_rules import RULES, SYMBOLS, Rule
from unitlens.llm.text import STOP_WORDS

SPACE = r"[\x20\x09-\x0D]+"
WORDS = rf"""
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS words FROM docs
)"""


def _broken(rule: Rule) -> str:
    ratio = f"{rule.above} / nullif({rule.below}, 0)"
    low = [] if rule.least is None else [f"{ratio} < {rule.least}"]
    high = [] if rule.most is None else [f"{ratio} > {rule.most}"]
    return f"coalesce({' OR '.join(low + high)}, false)"


_STOP = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
QUALITY = rf"""WITH {WORDS},
grams AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeated AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
),
lined AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM split
),
measured AS (
  SELECT doc_id, len(words) AS n_words, len(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
         len(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(t) - len(replace(t, '!', '')) AS n_exclamations,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda x: substr(ltrim(x), 1, 1) IN ('-', '*', '•'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: ends_with(rtrim(x), '...'))) AS n_ellipsis_lines
  FROM lined LEFT JOIN repeated USING (r)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(map(_broken, RULES))}) AS kept
FROM judged"""

JACCARD = rf"""WITH RECURSIVE
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
split AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS words FROM docs),
grams AS (
  SELECT DISTINCT r, array_to_string(words[i:i + 2], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM split WHERE len(words) > 0)
),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * shared.n >= 90 * (p.n + q.n - shared.n)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT r AS x, r AS y FROM docs
  UNION
  SELECT reached.x, both_ways.y FROM reached JOIN both_ways ON reached.y = both_ways.x
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s USING (r) JOIN reached ON reached.x = d.r JOIN docs e ON e.r = reached.y
GROUP BY d.r, d.doc_id"""

SUBSTRINGS = rf"""WITH {WORDS},
windows AS (
  SELECT r, doc_id, i, array_to_string(words[i:i + 19], ' ') AS g
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split WHERE len(words) >= 20)
),
later AS (SELECT r, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, r, i) > 1),
gone AS (SELECT DISTINCT r, i + k AS at FROM later, (SELECT unnest(range(0, 20)) AS k)),
placed AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS at FROM split),
kept AS (
  SELECT placed.r, count(gone.at) AS n_removed, string_agg(word, ' ' ORDER BY placed.at) FILTER (WHERE gone.at IS NULL) AS rest
  FROM placed LEFT JOIN gone ON gone.r = placed.r AND gone.at = placed.at GROUP BY placed.r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)"""

def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: The remainder of CRC-32 before it is inverted, so an odd one belongs to an even CRC-32.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(id) + 1), lambda i: ascii(id[i])::BIGINT)),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"""
_NEXT = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"
_PLACE = "(pos // (3 ** k)::BIGINT)"
_RUN = f"({_PLACE} - {_PLACE} % 3)"
_SIBLINGS = f"""array_to_string(nodes[{_RUN} + 1:{_PLACE}], '') AS lefts, array_to_string(nodes[{_PLACE} + 2:{_RUN} + 3], '') AS rights"""
MERKLE = rf"""WITH RECURSIVE
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS changed,
         doc_id::VARCHAR AS id
  FROM documents
),
shown AS (SELECT *, CASE WHEN {_CRC} & 1 = 1 THEN changed ELSE leaf END AS claimed FROM leaves),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM shown
),
levels AS (
  SELECT source, 0 AS k, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, k + 1, {_NEXT} FROM levels WHERE len(nodes) > 1
),
tops AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM levels WHERE len(nodes) = 1
),
upper_levels AS (
  SELECT 0 AS k, list(subroot ORDER BY pos) AS nodes FROM tops
  UNION ALL
  SELECT k + 1, {_NEXT} FROM upper_levels WHERE len(nodes) > 1
),
steps AS (
  SELECT r, k, {_SIBLINGS} FROM placed JOIN levels ON placed.source IS NOT DISTINCT FROM levels.source WHERE len(nodes) > 1
  UNION ALL
  SELECT r, 100 + k, lefts, rights
  FROM (SELECT source, k, {_SIBLINGS} FROM tops, upper_levels WHERE len(nodes) > 1) above
  JOIN placed ON placed.source IS NOT DISTINCT FROM above.source
),
counted AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM steps),
folds AS (
  SELECT r, 0::BIGINT AS i, claimed AS h FROM placed
  UNION ALL
  SELECT folds.r, counted.i, sha256(lefts || h || rights) FROM folds JOIN counted ON counted.r = folds.r AND counted.i = folds.i + 1
),
proofs AS (SELECT r, string_agg(lefts || rights, '' ORDER BY i) AS p, max(i) AS i FROM counted GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed LEFT JOIN proofs USING (r) JOIN folds ON folds.r = placed.r AND folds.i = coalesce(proofs.i, 0)
JOIN tops ON placed.source IS NOT DISTINCT FROM tops.source, (SELECT nodes[1] AS root FROM upper_levels WHERE len(nodes) = 1)"""

PHRASES = rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
phrases AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM phrases, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL
),
free AS (
  SELECT p.* FROM phrases p LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM free),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts
  JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[:c], ' ')
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[c + 1:], ' ')
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

BYTES = """WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS g
  FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM docs WHERE len(h) >= 400)
),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
marked AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again
),
spans AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b
  FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM marked) GROUP BY r, k
),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT docs.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS rest
  FROM docs JOIN gaps ON gaps.r = docs.r GROUP BY docs.r
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)"""

ORACLE = {
    "op1_quality_rules": QUALITY,
    "op11_merkle_manifest": MERKLE,
    "op12_phrase_mining": PHRASES,
    "op4_ngram_jaccard_join": JACCARD,
    "op7_suffix_dedup": BYTES,
    "op8_substring_dedup": SUBSTRINGS,
}
