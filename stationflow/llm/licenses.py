"""Licence recognition by sentence rules, in DataFrame functions.

Sentences are normalised and mapped to identifiers of known licence sentences, also where these are wrapped over lines. A licence is recognised where a rule's
identifiers stand in the document in the rule's order, with at most ``GAP`` other sentences between them. The known
sentences and rules are a short fixed list and part of the plan, so documents are read once and never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import ascii_lower, bind

GAP = 3

#: A known sentence may be wrapped over so many pieces.
PIECES = 100
#: Every text with a known sentence has one of these.
HINTS = "licen|copyright|redistribut|warranty|permission|cc0"

# Known licence sentences, normalised (lower case, one space between runs of letters and digits).
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-release": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

# Ordered rules, as licence and the sentences that state it.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-use", "apache-copy")),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL", ("gpl-free", "gpl-warranty")),
    ("BSD", ("bsd-redistribution", "bsd-source")),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC0-1.0", ("cc0",)),
    ("MPL-2.0", ("mpl-notice",)),
)

# The same sentences as the licences' own texts have them.
_GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
_GPL += " as published by the free software foundation"
_BSD = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_WAIVED = "all copyright and related or neighboring rights to this"
FULL = (
    ("apache-notice", "licensed under the apache license version 2 0 the license"),
    ("apache-copy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    (
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
        "do so subject to the following conditions",
    ),
    *(("gpl-free", f"{_GPL} either version {n} of the license or at your option any later version") for n in (2, 3)),
    *(("gpl-free", f"{_GPL}{end}") for n in (2, 3) for end in (f" version {n}", f" version {n} of the license")),
    (
        "gpl-warranty",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose",
    ),
    (
        "bsd-redistribution",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
    ),
    ("bsd-source", _BSD),
    ("bsd-source", f"1 {_BSD}"),
    *(("cc0", f"to the extent possible under law the {who} waived {_WAIVED} {what}")
      for who in ("author has", "author s have", "authors have") for what in ("work", "software")),
    (
        "cc0",
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software "
        "to the public domain worldwide",
    ),
    ("cc0", "cc0 1 0 universal"),
)

#: Where pieces end: marks before white space or the end, or a line's end.
ENDS = r"[.!?;]+(?:[\x20\x09-\x0D]+|$)|[\x0A-\x0D]+"
BETWEEN = "[^a-z0-9]+"


def sentence_ids(text: Column) -> Column:
    """Array of (position, last, id) of the known sentences among all pieces of the text, in order; empty for NULL.

    A known sentence is one piece or several that follow each other, since licences are wrapped and have marks within a
    sentence (``v. 2.0``); from ``position`` to ``last``. Of those that begin at one piece the longest counts.
    """
    forms = [*((sentence, key) for key, sentence in SENTENCES.items()), *((sentence, key) for key, sentence in FULL)]
    known = F.create_map(*[F.lit(x) for form in forms for x in form])
    firsts = sorted({sentence.split()[0] for sentence, _ in forms})
    none = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("n"), F.lit(0).alias("last"))

    def step(state: Column, piece: Column) -> Column:
        joined = F.trim(F.concat(state["text"], F.lit(" "), piece))
        found = F.try_element_at(known, joined)
        ends = found.isNotNull() & (piece != "")
        last = F.when(ends, state["n"]).otherwise(state["last"])
        return F.struct(joined.alias("text"), F.coalesce(found, state["id"]).alias("id"), (state["n"] + 1).alias("n"), last.alias("last"))

    def sentences(normal: Column) -> Column:
        def at(piece: Column, i: Column) -> Column:
            begins = F.substring_index(piece, " ", 1).isin(firsts)
            found = F.when(begins, F.aggregate(F.slice(normal, i + 1, PIECES), none, step))
            return F.struct(i.alias("position"), (i + found["last"]).alias("last"), found["id"].alias("id"))

        return F.filter(F.transform(normal, at), lambda x: x["id"].isNotNull())

    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), ENDS)
    normal = F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, BETWEEN, " ")))
    hinted = ascii_lower(F.coalesce(text, F.lit(""))).rlike(HINTS)
    found = bind(normal, sentences)
    return F.when(hinted, found).otherwise(F.array().cast("array<struct<position:int,last:int,id:string>>"))


def _ends(found: Column, rule: tuple[str, ...], gap: int) -> Column:
    """Number of places at which the rule's last sentence completes it.

    The state holds, for each of the rule's sentences, the last position at which it completed the rule up to there.
    """
    never = -(1 << 30)
    k = len(rule)
    start = F.struct(F.array_repeat(F.lit(never), k).alias("at"), F.lit(0).alias("n"))

    def step(state: Column, x: Column) -> Column:
        reached = [x["id"] == rule[0]]
        for j in range(1, k):
            reached.append((x["id"] == rule[j]) & (x["position"] - state["at"][j - 1] <= gap + 1))
        at = F.array(*[F.when(reached[j], x["last"]).otherwise(state["at"][j]) for j in range(k)])
        return F.struct(at.alias("at"), (state["n"] + reached[-1].cast("int")).alias("n"))

    return F.aggregate(found, start, step)["n"]


def recognised(docs: DataFrame, rules=RULES, gap: int = GAP) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, n_matches) of every row.

    ``sentence_ids`` are the known sentences in order, ``licenses`` the recognised licences, sorted and without repeats, both
    comma-joined; ``n_matches`` counts the places at which a rule is completed. NULL and empty texts have none.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("_found"))

    def result(x: Column) -> Column:
        counted = [(licence, _ends(x, rule, gap)) for licence, rule in rules]
        names = F.array(*[F.when(n > 0, F.lit(licence)) for licence, n in counted])
        return F.struct(
            F.size(x).cast("long").alias("n_sentences"),
            F.array_join(F.transform(x, lambda s: s["id"]), ",").alias("sentence_ids"),
            F.array_join(F.array_sort(F.array_distinct(F.array_compact(names))), ",").alias("licenses"),
            sum((n for _, n in counted[1:]), counted[0][1]).cast("long").alias("n_matches"),
        )

    none = F.struct(
        F.lit(0).cast("long").alias("n_sentences"), F.lit("").alias("sentence_ids"), F.lit("").alias("licenses"),
        F.lit(0).cast("long").alias("n_matches"),
    )
    out = bind(F.col("_found"), lambda x: F.when(F.size(x) > 0, result(x)).otherwise(none))
    return found.select("doc_id", out.alias("_r")).select("doc_id", "_r.*")
