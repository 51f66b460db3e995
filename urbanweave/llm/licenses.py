"""License scans by ordered signature rules, in DataFrame functions only.

A text is normalised to its lower-cased words, each with a space on either side
(`` mit  license ``). Hundreds of signatures (families and versions by phrase
templates) match whole words there. A rule is tried only where its keyword
occurs. Sentences of licence texts and notices, glued versions (``gplv3``) and
``license: NAME`` fields are hand-written rules beside them. Of overlapping detections, one that lies inside another of the same or a
higher priority is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.common import in_chunks, keyed_texts

# Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Label, keyword (where the name has it), spellings of the name (words; "?" after
# optional ones, and before one that may be joined to the word before), versions.
FAMILIES = [
    ("mit", "mit", ["mit", "expat"], []),
    ("apache", "apache", ["apache", "apache software"], ["1.0", "1.1", "2.0"]),
    ("gpl", "gpl", ["gpl", "gnu gpl"], ["1.0", "2.0", "3.0"]),
    ("gpl", "general", ["gnu? general public"], ["1.0", "2.0", "3.0"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], ["2.0", "2.1", "3.0"]),
    ("lgpl", "lesser", ["gnu? lesser general public"], ["2.0", "2.1", "3.0"]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], ["1.0", "3.0"]),
    ("agpl", "affero", ["gnu? affero general public"], ["1.0", "3.0"]),
    ("gfdl", "documentation", ["gnu? free documentation"], ["1.1", "1.2", "1.3"]),
    ("mpl", "mpl", ["mpl"], ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla", ["mozilla public"], ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", ["eclipse public"], ["1.0", "2.0"]),
    ("edl", "distribution", ["eclipse distribution"], ["1.0"]),
    ("eupl", "eupl", ["eupl"], ["1.0", "1.1", "1.2"]),
    ("cddl", "cddl", ["cddl"], ["1.0", "1.1"]),
    ("cddl", "development", ["common development and distribution"], ["1.0", "1.1"]),
    ("cpl", "common", ["common public"], ["1.0"]),
    ("ipl", "ibm", ["ibm public"], ["1.0"]),
    ("bsd", "bsd", ["bsd", "berkeley software distribution"], []),
    ("bsd-2-clause", "bsd", ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"], []),
    ("bsd-3-clause", "bsd", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"], []),
    ("bsd-4-clause", "bsd", ["bsd 4 clause", "4 clause bsd", "original bsd"], []),
    ("0bsd", "bsd", ["zero clause bsd"], []),
    ("isc", "isc", ["isc"], []),
    ("zlib", "zlib", ["zlib", "zlib libpng"], []),
    ("libpng", "libpng", ["libpng"], ["2.0"]),
    ("bsl", "boost", ["boost software", "boost"], ["1.0"]),
    ("artistic", "artistic", ["artistic"], ["1.0", "2.0"]),
    ("afl", "academic", ["academic free"], ["1.1", "2.0", "2.1", "3.0"]),
    ("ecl", "educational", ["educational community"], ["1.0", "2.0"]),
    ("osl", "open", ["open software"], ["1.0", "2.0", "2.1", "3.0"]),
    ("ofl", "font", ["sil? open font"], ["1.0", "1.1"]),
    ("odbl", "database", ["open database", "open data commons open database"], ["1.0"]),
    ("pddl", "dedication", ["public domain dedication and"], ["1.0"]),
    ("ms-pl", "microsoft", ["microsoft public"], []),
    ("ms-rl", "microsoft", ["microsoft reciprocal"], []),
    ("postgresql", "postgresql", ["postgresql"], []),
    ("python", "python", ["python software foundation", "python"], ["2.0"]),
    ("php", "php", ["php"], ["3.0", "3.01"]),
    ("ruby", "ruby", ["ruby"], []),
    ("openssl", "openssl", ["openssl"], []),
    ("unlicense", "unlicense", ["unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["2.0"]),
    ("x11", "x11", ["x11"], []),
    ("ncsa", "ncsa", ["ncsa", "university of illinois ncsa open source"], []),
    ("qpl", "qpl", ["qpl", "q public"], ["1.0"]),
    ("cecill", "cecill", ["cecill"], ["1.0", "1.1", "2.0", "2.1"]),
    ("upl", "universal", ["universal permissive"], ["1.0"]),
    ("vim", "vim", ["vim"], []),
    ("cc0", "cc0", ["cc0", "creative commons zero"], ["1.0"]),
    ("cc-by", "cc", ["cc by"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", "cc", ["cc by sa"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc", "cc", ["cc by nc"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", "cc", ["cc by nd"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd"], ["1.0", "2.0", "2.5", "3.0", "4.0"]),
    ("cc-by", "creative", ["creative commons attribution"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-sa", "creative", ["creative commons attribution share ?alike"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nc", "creative", ["creative commons attribution non ?commercial"], ["2.0", "2.5", "3.0", "4.0"]),
    ("cc-by-nd", "creative", ["creative commons attribution no ?derivatives"], ["2.0", "2.5", "3.0", "4.0"]),
]

# Sentences of licence texts and notices: label, keyword, words ("?" as above; "N" is up
# to twelve words), priority. A sentence that two licences share has the label of the more general one, at a
# lower priority than the sentence that tells them apart.
SENTENCES = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of", 2),
    ("ncsa", "deal", "to deal with the software without restriction", 3),
    ("x11", "consortium", "the name of the x consortium shall not be used in advertising", 3),
    ("bsl-1.0", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 3),
    ("isc", "fee", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided", 3),
    ("0bsd", "fee", "permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted the software", 3),
    ("hpnd", "fee", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 3),
    ("hpnd", "sell", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 3),
    ("postgresql", "fee", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 3),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("bsd-3-clause", "endorse", "nor the names of its contributors may be used to endorse or promote products derived from this software", 3),
    ("bsd-3-clause", "endorse", "the name of the author may not be used to endorse or promote products derived from this software", 3),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following", 3),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 3),
    ("zlib", "held", "in no event will the authors be held liable for any damages arising from the use of this software", 2),
    ("apache", "required", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 2),
    ("apache-2.0", "reproduction", "terms and conditions for use reproduction and distribution", 3),
    ("apache-2.0", "apache", "www apache org licenses license 2 0", 3),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 3),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 3),
    ("gpl-2.0", "general", "gnu general public license as published by the free software foundation either? version 2", 3),
    ("gpl-3.0", "general", "gnu general public license as published by the free software foundation either? version 3", 3),
    ("lgpl-2.0", "general", "gnu library general public license as published by the free software foundation either? version 2", 3),
    ("lgpl-2.1", "lesser", "gnu lesser general public license as published by the free software foundation either? version 2 1", 3),
    ("lgpl-3.0", "lesser", "gnu lesser general public license as published by the free software foundation either? version 3", 3),
    ("agpl-3.0", "affero", "gnu affero general public license as published by the free software foundation either? version 3", 3),
    ("gpl", "redistribute", "you can redistribute it and or? modify it under the terms of the gnu general public license", 2),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 3),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 3),
    ("epl-1.0", "eclipse", "made available under the terms of the eclipse public license v 1 0", 3),
    ("epl-2.0", "eclipse", "made available under the terms of the eclipse public license v 2 0", 3),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 3),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 3),
    ("cc0-1.0", "waived", "to the extent possible under law N has waived all copyright and related or neighboring rights", 3),
    ("cc0", "neighboring", "waived all copyright and related or neighboring rights", 2),
    ("php-3.01", "php", "this source file is subject to version 3 01 of the php license", 3),
]

# Names glued to their version, by label; further words of the name after a space.
GLUED = {
    "gpl-1.0": ["gplv1", "gpl1"], "gpl-2.0": ["gplv2", "gpl2"], "gpl-3.0": ["gplv3", "gpl3"],
    "lgpl-2.0": ["lgplv2", "lgpl2"], "lgpl-2.1": ["lgplv2 1", "lgpl2 1", "lgplv21", "lgpl21"], "lgpl-3.0": ["lgplv3", "lgpl3"],
    "agpl-1.0": ["agplv1"], "agpl-3.0": ["agplv3", "agpl3"],
    "apache-2.0": ["apachev2", "apache2", "asl2", "aslv2"], "mpl-1.1": ["mplv1 1", "mpl1 1"], "mpl-2.0": ["mplv2", "mpl2"],
    "epl-1.0": ["eplv1"], "epl-2.0": ["eplv2"], "eupl-1.2": ["euplv1 2"], "cddl-1.0": ["cddlv1"],
    "bsd-2-clause": ["bsd2"], "bsd-3-clause": ["bsd3"], "0bsd": ["0bsd"],
}

# Names in "license: NAME" fields, by label. Names that are common words are left out.
FIELDS = {
    "mit": ["mit", "expat"], "isc": ["isc"], "0bsd": ["0bsd"], "bsd": ["bsd"], "bsd-2-clause": ["bsd 2 clause"], "bsd-3-clause": ["bsd 3 clause"],
    "bsd-4-clause": ["bsd 4 clause"], "apache": ["apache", "asl"], "apache-1.1": ["apache 1 1"], "apache-2.0": ["apache 2", "apache 2 0", "asl 2 0"],
    "gpl": ["gpl"], "gpl-1.0": ["gpl 1", "gpl 1 0"], "gpl-2.0": ["gpl 2", "gpl 2 0"], "gpl-3.0": ["gpl 3", "gpl 3 0"],
    "lgpl": ["lgpl"], "lgpl-2.0": ["lgpl 2 0"], "lgpl-2.1": ["lgpl 2 1"], "lgpl-3.0": ["lgpl 3", "lgpl 3 0"],
    "agpl": ["agpl"], "agpl-3.0": ["agpl 3", "agpl 3 0"], "mpl": ["mpl"], "mpl-1.1": ["mpl 1 1"], "mpl-2.0": ["mpl 2 0"],
    "epl-1.0": ["epl 1 0"], "epl-2.0": ["epl 2 0"], "eupl-1.2": ["eupl 1 2"], "cddl-1.0": ["cddl 1 0"], "bsl-1.0": ["bsl 1 0"],
    "cc0": ["cc0"], "cc0-1.0": ["cc0 1 0"], "cc-by-4.0": ["cc by 4 0"], "cc-by-sa-4.0": ["cc by sa 4 0"], "cc-by-nc-4.0": ["cc by nc 4 0"],
    "ofl-1.1": ["ofl 1 1"], "artistic-2.0": ["artistic 2 0"], "zlib": ["zlib"], "unlicense": ["unlicense"], "wtfpl": ["wtfpl"],
    "postgresql": ["postgresql"], "python-2.0": ["psf 2 0", "python 2 0"], "ms-pl": ["ms pl"], "upl-1.0": ["upl 1 0"], "ncsa": ["ncsa"],
}

# Templates with their priority; {} is the name.
GRANT, NAMED, TAG, BARE = 3, 2, 4, 1
PRIORITIES = 4


def words(phrase: str) -> str:
    """Pattern of a phrase over normalised text: ``gnu? general`` has an optional first word, ``share ?alike`` may be one word."""
    out, tokens = "", phrase.split()
    for i, token in enumerate(tokens):
        if token.startswith("?"):
            out = out.removesuffix(" ") + f"(?:  )?{token[1:]} "
        elif token.endswith("?"):
            out += f"(?: {token[:-1]} )?"
        elif token == "N":
            out += "(?: [^ ]+ ){1,12}"
        else:
            out += f" {token} "
    return out


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int


def signatures() -> list[Signature]:
    """The rules: every name of a family, plain and by version, in every template, and the hand-written ones."""
    rules = []
    lead = f"(?:{'|'.join(words(w) for w in ('licensed', 'released', 'distributed', 'available', 'published', 'provided'))})"
    under = f"{lead}{words('under')}{words('the?')}(?:{words('terms of the?')})?{words('the?')}"
    licence = "(?: licen[cs]e )"
    tag = words("spdx license identifier")
    for label, common, names, versions in FAMILIES:
        for name in names:
            # The keyword must be a word that every match has.
            sure = [w for w in name.split() if not w.endswith("?") and not w.startswith("?")]
            keyword = common if common in sure else max(sure, key=len)
            named = words(name)
            rules.append(Signature(label, keyword, f"{under}{named}{licence}?", GRANT))
            rules.append(Signature(label, keyword, f"{named}{licence}", BARE))
            rules.append(Signature(label, keyword, f"{tag}{named}", TAG))
            for version in versions:
                # "2.0" is the words 2 and 0; a trailing 0 is often left out.
                major, _, minor = version.partition(".")
                number = f"(?: {major} (?: 0 )?| v{major} (?: 0 )?)" if minor == "0" else f"(?: v?{major}  {minor} )"
                rules.append(Signature(f"{label}-{version}", keyword, f"{under}{named}{licence}?(?: version )?{number}", GRANT))
                rules.append(Signature(f"{label}-{version}", keyword, f"{named}{licence}?(?: version )?{number}", NAMED))
                rules.append(Signature(f"{label}-{version}", keyword, f"{tag}{named}{number}", TAG))
    rules += [Signature(label, keyword, words(sentence), priority) for label, keyword, sentence, priority in SENTENCES]
    for label, names in GLUED.items():
        for name in names:
            rules.append(Signature(label, name.split()[0], f"{under}{words(name)}", GRANT))
            rules.append(Signature(label, name.split()[0], words(name), NAMED))
    # A field ends the text or has a word behind it, not again "license": normalised words have no colon,
    # and "license mit license" names the licence behind it. The word is part of the match.
    behind = "(?:$| (?:[^l ][^ ]*|l|l[^i ][^ ]*|li|li[^c ][^ ]*|lic|lic[^e ][^ ]*|lice|lice[^n ][^ ]*) )"
    for label, names in FIELDS.items():
        for name in names:
            rules.append(Signature(label, max(name.split(), key=len), f"{licence}{words(name)}{behind}", GRANT if any(map(str.isdigit, name)) else NAMED))
    return rules


SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DETECTION = "struct<start:bigint,back:bigint,end:bigint,priority:int,label:string>"


def normalised(text: Column) -> Column:
    """Lower-cased words with a space on either side each; the empty string if there are none.

    Only A-Z are to be lower-cased. Lower-casing everything keeps every other word a
    word and no ASCII one, save for the two letters whose lower case is ASCII.
    """
    lowered = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("é")), F.lit("İ"), F.lit("é")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, SEPARATORS, "  ")), F.lit(" "))


def _words_in(part: Column) -> Column:
    return F.try_divide(F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit(""))), F.lit(2)).cast("bigint")


def _places(text: Column, pattern: Column, priority: Column, label: Column) -> Column:
    """Detections of a pattern: word ranges from the texts between the matches."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def step(seen: Column, piece: Column) -> Column:
        start = seen["at"] + _words_in(piece["gap"])
        end = start + _words_in(piece["hit"])
        one = F.struct(start.alias("start"), (-end).alias("back"), end.alias("end"), priority.alias("priority"), label.alias("label"))
        return F.struct(end.alias("at"), F.concat(seen["found"], F.array(one).cast(f"array<{_DETECTION}>")).alias("found"))

    def advance(at: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, at, lambda seen, piece: seen + _words_in(piece["gap"]) + _words_in(piece["hit"]))

    def work(chunk: Column, at: Column) -> Column:
        first = F.struct(at.alias("at"), F.array().cast(f"array<{_DETECTION}>").alias("found"))
        return F.aggregate(chunk, first, step, lambda seen: seen["found"])

    return F.flatten(in_chunks(pieces, F.lit(0).cast("bigint"), advance, work))


def _unsuppressed(found: Column) -> Column:
    """Detections not inside an equal or higher ranked one: one sweep by start, longest first, highest priority first."""
    ordered = F.array_sort(F.transform(found, lambda d: d.withField("priority", -d["priority"])))

    levels = range(1, PRIORITIES + 1)

    def ends(seen: Column, d: Column) -> list[Column]:
        """The largest end seen of each priority."""
        return [F.when(-d["priority"] == level, F.greatest(seen[f"e{level}"], d["end"])).otherwise(seen[f"e{level}"]).alias(f"e{level}") for level in levels]

    def step(seen: Column, d: Column) -> Column:
        rank = -d["priority"]
        inside = F.lit(False)
        for level in levels:
            inside = inside | ((rank <= level) & (seen[f"e{level}"] >= d["end"]))
        kept = F.when(inside, seen["kept"]).otherwise(F.concat(seen["kept"], F.array(d.withField("priority", rank))))
        return F.struct(*ends(seen, d), kept.alias("kept"))

    def advance(state: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, state, lambda seen, d: F.struct(*ends(seen, d)))

    def work(chunk: Column, state: Column) -> Column:
        first = F.struct(*[state[f"e{level}"].alias(f"e{level}") for level in levels], F.array().cast(f"array<{_DETECTION}>").alias("kept"))
        return F.aggregate(chunk, first, step, lambda seen: seen["kept"])

    none = F.struct(*[F.lit(-1).cast("bigint").alias(f"e{level}") for level in levels])
    return F.flatten(in_chunks(ordered, none, advance, work))


def detect(docs: DataFrame, rules: list[Signature] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, base (start, label by place) and detections left after suppression.

    A null or empty text has no words and no detection. Rows that share a doc_id
    are judged one by one. Other columns of ``docs`` are not read. Ties (equal
    ranges of equal priority) go to the first label. No row is moved: the scan is
    one pass without a shuffle.
    """
    rules = signatures() if rules is None else rules
    by_keyword: dict[str, list[Column]] = {}
    for r in rules:
        rule = F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"))
        by_keyword.setdefault(r.keyword, []).append(rule)
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*held).alias("rules")) for k, held in by_keyword.items()])
    none = F.array().cast(f"array<{_DETECTION}>")
    gates = sorted({*by_keyword, *(phrase.split()[0] for phrase, _ in BASE)})
    # Each step reads the one before more than once, so each is a column of its own.
    cut = keyed_texts(docs).select("doc_id", "text", F.split(F.lower(F.coalesce("text", F.lit(""))), SEPARATORS, -1).alias("parts"))
    empties = (F.element_at("parts", 1) == "").cast("long") + ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("long")
    present = F.array_intersect("parts", F.array(*map(F.lit, gates)))
    gated = cut.select("doc_id", "text", (F.size("parts") - empties).alias("n_words"), present.alias("present"))
    norms = gated.select("doc_id", "n_words", "present", F.when(F.size("present") > 0, normalised(F.col("text"))).otherwise(F.lit("")).alias("norm"))
    text = F.col("norm")
    chosen = F.filter(table, lambda k: F.array_contains("present", k["keyword"]))
    held = norms.select("doc_id", "n_words", "norm", F.when(F.size("present") > 0, F.flatten(F.transform(chosen, lambda k: k["rules"]))).alias("rules"))
    found = F.flatten(F.transform("rules", lambda r: _places(text, r["pattern"], r["priority"], r["label"])))
    base = [
        F.when(F.contains(text, F.lit(words(phrase))), _places(text, F.lit(words(phrase)), F.lit(BARE), F.lit(label))).otherwise(none)
        for phrase, label in BASE
    ]
    seen = held.select("doc_id", "n_words", F.concat(*base).alias("base"), F.when(F.size("rules") > 0, found).otherwise(none).alias("found"))
    return seen.select("doc_id", "n_words", "base", F.when(F.size("found") > 0, _unsuppressed(F.col("found"))).otherwise(none).alias("detections"))


def with_digest(found: DataFrame) -> DataFrame:
    """``detect`` rows as counts, first and last base place, label lists and a score.

    The score is the highest priority left over the highest there is, a base
    phrase counting as a bare name, 0 without any label.
    """
    starts, base = F.transform("base", lambda d: d["start"]), F.transform("base", lambda d: d["label"])
    labels = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    best = F.greatest(F.array_max(F.transform("detections", lambda d: d["priority"])), F.when(F.size("base") > 0, F.lit(BARE)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(best / F.lit(float(PRIORITIES)), F.lit(0.0)).alias("score"),
    )
