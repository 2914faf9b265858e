"""Licence scans by a positional rare-token index, in SQL functions only.

Templates are the words of licence notices, grants, conditions and disclaimers; an inverse document frequency over them
says how rare a word is among licences.  The index holds the places in their templates of all words that few templates
have, so that the words of ordinary prose are not in it.  A file's words that are in the index are its licence words; its
LOOKED_UP different ones of highest frequency rank are looked up.  Each of their places in the file, less a place in a
template, is a relative position at which that template may lie.  Where two words agree on one (neighbours after sorting,
so linear in the number of places but for the sort) there is an alignment; it counts if the template's key phrase stands
word for word where it must.  Its score is the share of the template's frequencies whose words stand at their places.

Everything is local to a row: no shuffle, no join, and memory is bounded by one text.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed values: (label, template, key phrase), words of public licence texts in lower case.
TEMPLATES = [
    ("agpl-notice", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "by the copyright holders and contributors as is"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "any person or organization obtaining a copy of the software"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("gpl-notice", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "terms of the gnu general public license"),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program", "see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee"),
    ("lgpl-notice", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge to any person"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction"),
    ("mit-grant", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "terms of the mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "in no event will the authors be held liable for any damages"),
]
#: Share of the templates that may have a word of the index, different licence words of a file that are looked up, and
#: the score from which an alignment gives its label.
RARE, LOOKED_UP, FROM = 0.25, 24, 0.5
#: Words after A-Z became a-z, and the same words where A-Z are still there.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _idf() -> dict[str, float]:
    sets = [set(t.split()) for _, t, _ in TEMPLATES]
    return {w: round(log(1 + len(sets) / sum(w in s for s in sets)), 6) for w in sorted(set().union(*sets))}


def _index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Places (template, word number) of the words that at most a share RARE of the templates has."""
    least = log(1 + 1 / RARE)
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(TEMPLATES):
        for q, w in enumerate(words.split()):
            if idf[w] >= least:
                out.setdefault(w, []).append((t, q))
    return out


def _list(values) -> str:
    return "array(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v) for v in values) + ")"


def _stands(words: list[str], at: str) -> str:
    return " AND ".join(f"get(w, CAST({at} + {i} AS INT)) = '{x}'" for i, x in enumerate(words))


def _found_sql(idf: dict[str, float], index: dict[str, list[tuple[int, int]]]) -> str:
    """Verified alignments (t, score) of a row's words w; seen: its words of the index with their places, (x, i)."""
    words = sorted(index)
    rank = {w: k for k, w in enumerate(sorted(words, key=lambda w: (-idf[w], w)))}
    number = f"array_position({_list(sorted(words, key=rank.get))}, s.x)"  # 1 for the rarest word
    postings = "array(" + ", ".join("array(" + ", ".join(f"named_struct('t', {t}, 'q', {q})" for t, q in index[w]) + ")" for w in sorted(words, key=rank.get)) + ")"
    ranked = f"transform(seen, s -> named_struct('k', CAST({number} AS INT), 'i', s.i))"
    bound = f"element_at(array_sort(array_distinct(transform(ranked, r -> r.k))), least({LOOKED_UP}, size(array_distinct(transform(ranked, r -> r.k)))))"
    places = f"flatten(transform(filter(ranked, r -> r.k <= bound), r -> transform(element_at({postings}, r.k), p -> named_struct('t', p.t, 'o', r.i - p.q))))"
    alike = "array_distinct(filter(transform(o_all, (v, i) -> if(i > 0 AND get(o_all, i - 1) = v, v, NULL)), v -> v IS NOT NULL))"
    keys, texts = [], []
    for _, t, k in TEMPLATES:
        t, k = t.split(), k.split()
        keys.append((next(i for i in range(len(t)) if t[i : i + len(k)] == k), len(k)))
        texts.append(f"named_struct('w', {_list(t)}, 'f', {_list([idf[x] for x in t])}, 'total', {sum(idf[x] for x in t)!r}D)")
    template = f"get(array({', '.join(texts)}), a.t)"
    begin, size = (f"get({_list([k[n] for k in keys])}, a.t)" for n in (0, 1))
    key = f"forall(sequence(0, {size} - 1), j -> get(w, a.o + {begin} + j) <=> get(tpl.w, {begin} + j))"
    share = "aggregate(sequence(0, size(tpl.w) - 1), 0D, (acc, q) -> acc + if(get(w, a.o + q) = get(tpl.w, q), get(tpl.f, q), 0D)) / tpl.total"
    scored = f"transform({alike}, a -> element_at(transform(array({template}), tpl -> if({key}, named_struct('t', a.t, 'score', {share}), NULL)), 1))"
    with_ = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    return with_("ranked", ranked, with_("bound", bound, with_("o_all", f"array_sort({places})", f"filter({scored}, a -> a IS NOT NULL)")))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``df``.

    Null texts count as empty: no words, no labels (empty strings), score 0.  A null id, or one that isn't a number,
    gives a null id; repeated rows give repeated rows; other columns aren't read; an empty table gives an empty table.
    """
    idf = _idf()
    index = _index(idf)
    # a word that lower() shortens or lengthens holds other letters than A-Z that fold into a-z; it is left as it is
    folded = F.transform(F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(_WORD_ANY_CASE), 0), lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(x))
    rows = df.select(F.col(id_col).try_cast("long").alias("doc_id"), folded.alias("w"))
    known = sorted(set(index) | {p.split()[0] for p in BASE})
    rows = rows.withColumn("known", F.expr(f"filter(transform(w, (x, i) -> named_struct('x', x, 'i', i)), s -> s.x IN ({', '.join(map(repr, known))}))"))
    rows = rows.withColumn("seen", F.expr(f"filter(known, s -> s.x IN ({', '.join(map(repr, sorted(index)))}))"))
    places = {label: f"transform(filter(known, s -> s.x = '{p.split()[0]}' AND {_stands(p.split(), 's.i')}), s -> s.i)" for p, label in BASE.items()}
    rows = rows.withColumns({f"p_{i}": F.expr(e) for i, e in enumerate(places.values())})
    rows = rows.withColumn("found", F.expr(f"if(size(seen) < 2, CAST(array() AS ARRAY<STRUCT<t: INT, score: DOUBLE>>), filter({_found_sql(idf, index)}, a -> a.score >= {FROM}D))"))
    base = F.array_compact(F.array(*[F.when(F.size(f"p_{i}") > 0, label) for i, label in enumerate(places)]))
    own = F.expr(f"transform(found, a -> get({_list([label for label, _, _ in TEMPLATES])}, a.t))")
    all_places = F.concat(*[F.col(f"p_{i}") for i in range(len(places))])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda a: a["score"])), F.lit(0.0)), 4).alias("score"),
    )


def _oracle() -> str:
    idf = _idf()
    index = _index(idf)
    rows = []
    for t, (label, words, k) in enumerate(TEMPLATES):
        words, k = words.split(), k.split()
        begin = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        rows += [f"({t}, '{label}', {q}, '{x}', {idf[x]}::DOUBLE, {x in index}, {begin <= q < begin + len(k)})" for q, x in enumerate(words)]
    phrases = " UNION ALL ".join(
        f"SELECT a.doc_id, a.i, '{label}' AS l FROM u a JOIN d USING (doc_id) WHERE a.x = '{p.split()[0]}' AND " + " AND ".join(f"d.w[a.i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())) for p, label in BASE.items()
    )
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
u AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM d),
t(t, label, q, x, idf, rare, key) AS (VALUES {', '.join(rows)}),
g AS (SELECT DISTINCT u.doc_id, x, idf FROM u JOIN (SELECT DISTINCT x, idf FROM t WHERE rare) USING (x)),
r AS (SELECT doc_id, x FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idf DESC, x) <= {LOOKED_UP}),
o AS (SELECT u.doc_id, t.t, label, i - q AS o FROM u JOIN r ON u.doc_id = r.doc_id AND u.x = r.x JOIN t ON t.x = u.x WHERE rare GROUP BY ALL HAVING count(*) >= 2),
v AS (
  SELECT o.doc_id, o.t, o.label, o.o, sum(CASE WHEN u.x = t.x THEN t.idf ELSE 0 END) / sum(t.idf) AS share, bool_and(NOT t.key OR coalesce(u.x = t.x, false)) AS ok
  FROM o JOIN t ON o.t = t.t LEFT JOIN u ON u.doc_id = o.doc_id AND u.i = o.o + t.q GROUP BY ALL),
m AS (SELECT doc_id, label, max(share) AS share FROM v WHERE ok GROUP BY ALL HAVING max(share) >= {FROM}),
b AS ({phrases}),
n AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT l, ',' ORDER BY l) AS base_labels FROM b GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM (SELECT doc_id, l FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS score FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 4)::DOUBLE AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""


ORACLE = _oracle()
