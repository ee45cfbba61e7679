"""License scans (operator 8): ordered signature rules over normalised words, in DataFrame functions only.

Texts pass a keyword prefilter first. The words of the texts that pass are joined by single spaces, and every
rule whose keyword is present is matched there; a match is an interval of words. Of overlapping
detections, one inside another is suppressed when the other has precedence (a smaller priority
number) or, at equal precedence, is longer. Everything happens within a row: no shuffle, no Python.

Rules are hand-written regexes: sentences of license bodies, addresses of license texts, rare licenses by name, and the
names of common licenses, each in every one of a few phrases; some hundreds in all. The
base phrases have a label of their own that is never suppressed.

Edge cases: null and empty texts have no words, no labels and a score of 0; texts are scanned whole;
rows do not influence each other, so repeated rows and ids are fine; of detections with equal precedence and length both stay; an
empty table gives no rows; columns named ``n_words`` or ``detections`` are replaced, all others carried by ``scan``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import numbered, table

#: Phrases that must be found as words, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: (label, keyword, name over normalised words, whether the name alone is a detection).
NAMES = [
    ("mit", "mit", "mit", False), ("mit-0", "mit", "mit (?:no attribution|0)", True), ("x11", "x11", "x11|mit x11", False),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1", True), ("apache-2", "apache", "apache(?: software)?(?: license| licence)?(?: version| v)? ?(?:2|2 0|v2)", True),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", True), ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)", True), ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)", True), ("0bsd", "bsd", "(?:0bsd|zero clause bsd)", True),
    ("isc", "isc", "isc", False), ("ncsa", "ncsa", "(?:ncsa|university of illinois ncsa)", False), ("zlib", "zlib", "zlib(?: libpng)?", False), ("postgresql", "postgresql", "postgresql", False),
    ("gpl-2", "gpl", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?(?: only| or later)?", True), ("gpl-2", "gnu", "gnu general public license(?: version| v) ?2", True), ("gpl-3", "gpl", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?(?: only| or later)?", True), ("gpl-3", "gnu", "gnu general public license(?: version| v) ?3", True),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:version |v)?2 1", True), ("lgpl-2.1", "lesser", "gnu lesser general public license(?: version| v) ?2 1", True), ("lgpl-3", "lgpl", "(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?", True), ("lgpl-3", "lesser", "gnu lesser general public license(?: version| v) ?3", True),
    ("agpl-3", "agpl", "(?:gnu )?agpl ?(?:version |v)?3(?: 0)?", True), ("agpl-3", "affero", "gnu affero general public license(?: version| v) ?3", True), ("gfdl-1.3", "gfdl", "(?:gnu )?gfdl ?(?:version |v)?1 3", True), ("gfdl-1.3", "documentation", "gnu free documentation license(?: version| v) ?1 3", True),
    ("mpl-1.1", "mpl", "mpl ?(?:version |v)?1 1", True), ("mpl-2", "mpl", "mpl ?(?:version |v)?2(?: 0)?", True), ("mpl-2", "mozilla", "mozilla public license(?: version| v) ?2", True), ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1", True), ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?2", True),
    ("cddl-1", "cddl", "cddl ?1 ?0?", True), ("artistic-1", "artistic", "artistic license 1(?: 0)?", True), ("artistic-2", "artistic", "artistic license 2(?: 0)?", True), ("unlicense", "unlicense", "unlicense", True), ("wtfpl", "wtfpl", "wtfpl", True), ("bsl-1", "boost", "boost software license(?: version)? 1", True),
    ("python-2", "python", "python software foundation(?: license version 2)?", False), ("python-2", "psf", "psf(?: license version 2)?", False), ("php-3", "php", "php(?: license version)? 3", False), ("openssl", "openssl", "openssl", False), ("ms-pl", "microsoft", "microsoft public", False), ("ms-rl", "microsoft", "microsoft reciprocal", False), ("eupl-1.2", "eupl", "eupl ?(?:v)?1 2", True),
    ("osl-3", "osl", "osl 3", True), ("osl-3", "open", "open software license 3", True), ("afl-3", "academic", "academic free license(?: version)? 3", True), ("cc0-1", "cc0", "cc0(?: 1 0)?", True), ("cc-by", "cc", "cc by(?! n[cd] | sa )(?: [1-4] [05])?", True), ("cc-by-sa", "cc", "cc by sa(?: [1-4] [05])?", True), ("cc-by-nd", "cc", "cc by nd(?: [1-4] [05])?", True), ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] [05])?", True),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] [05])?", True), ("cc-by", "creative", "creative commons attribution(?: [1-4] [05])?", True), ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] [05])?", True), ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] [05])?", True), ("odbl-1", "odbl", "odbl(?: 1 0)?", True),
    ("ofl-1.1", "ofl", "(?:sil )?ofl(?: 1 1)?", False), ("elastic-2", "elastic", "elastic(?: license)? 2(?: 0)?", False), ("sspl-1", "sspl", "sspl(?: v?1)?", True), ("busl-1.1", "busl", "busl(?: 1 1)?", True),
]

#: (priority, confidence, phrase; N is the name). The last is for names that are a detection alone.
PHRASES = [
    (1, 1.0, "spdx license identifier N"),
    (2, 0.95, "(?:licensed|released|distributed|published|available|provided|offered) under (?:the )?(?:terms of (?:the )?)?N(?: licen[sc]e)?"),
    (3, 0.9, "under the (?:terms|conditions)(?: and conditions)? of (?:the )?N(?: licen[sc]e)?"),
    (3, 0.9, "subject to (?:the )?(?:terms of (?:the )?)?N(?: licen[sc]e)?"),
    (4, 0.8, "N licen[sc]e"),
    (5, 0.7, "licen[sc]e(?:d)?(?: is)? N"),
    (6, 0.6, "N"),
]


#: (confidence, label, keyword, pattern): sentences of license bodies.
BODIES = [
    (0.9, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    (0.9, "bsl-1", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    (0.9, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    (0.9, "isc", "permission", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    (0.9, "gnu", "everyone", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    (0.9, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (0.9, "apache-2", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (0.9, "apache-2", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    (0.9, "bsd-3-clause", "neither", "neither the names? of (?:the )?(?:[0-9a-z]+ ){1,8}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    (0.9, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (0.9, "bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    (0.9, "zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (0.9, "zlib", "origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (0.9, "gpl", "general", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (0.9, "gpl-2", "version", "gnu general public license as published by the free software foundation either version 2 of the license"),
    (0.9, "gpl-3", "version", "gnu general public license as published by the free software foundation either version 3 of the license"),
    (0.9, "lgpl", "library", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    (0.9, "agpl-3", "affero", "under the terms of the gnu affero general public license as published by the free software foundation"),
    (0.9, "mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (0.9, "mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    (0.9, "epl-1", "eclipse", "made available under the terms of the eclipse public license v1 0"),
    (0.9, "epl-2", "eclipse", "made available under the terms of the eclipse public license(?: v)? ?2 0"),
    (0.9, "cddl-1", "common", "subject to the terms of the common development and distribution license"),
    (0.9, "wtfpl", "fuck", "do what the fuck you want to public license"),
    (0.9, "cc0-1", "deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    (0.9, "postgresql", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    (0.9, "ncsa", "deal", "to deal with the software without restriction"),
    (0.9, "x11", "consortium", "except as contained in this notice the name of (?:the )?x consortium shall not be used in advertising"),
    (0.9, "openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    (0.9, "php-3", "php", "this product includes php software freely available from"),
    (0.9, "python-2", "psf", "psf is making python available to licensee on an as is basis"),
    (0.9, "ofl-1.1", "ofl", "the ofl allows the licensed fonts to be used studied modified and redistributed freely"),
    (0.9, "elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    (0.9, "sspl-1", "functionality", "making the functionality of the program or modified version available to third parties as a service"),
    (0.9, "busl-1.1", "business", "the business source license this document or the license is not an open source license"),
    (0.9, "commons-clause", "sell", "the license does not grant to you the right to sell the software"),
    (0.9, "json", "evil", "the software shall be used for good not evil"),
    (0.9, "beerware", "retain", "as long as you retain this notice you can do whatever you want with this stuff"),
    (0.8, "perl-5", "perl", "under the same terms as perl itself"),
    (0.7, "public-domain", "domain", "(?:placed in|released (?:in)?to|dedicated to|is in) the public domain"),
    # addresses of license texts
    (0.9, "apache-2", "apache", "https? (?:www )?apache org licenses license 2 0"),
    (0.9, "mit", "opensource", "https? (?:www )?opensource org licenses? mit(?: license)?"),
    (0.9, "isc", "opensource", "https? (?:www )?opensource org licenses? isc(?: license)?"),
    (0.9, "bsd-2-clause", "opensource", "https? (?:www )?opensource org licenses? bsd 2 clause"),
    (0.9, "bsd-3-clause", "opensource", "https? (?:www )?opensource org licenses? bsd 3 clause"),
    (0.9, "gpl-2", "gnu", "https? (?:www )?gnu org licenses (?:old licenses )?gpl 2 0"),
    (0.9, "gpl-3", "gnu", "https? (?:www )?gnu org licenses gpl 3 0"),
    (0.9, "lgpl-2.1", "gnu", "https? (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1"),
    (0.9, "lgpl-3", "gnu", "https? (?:www )?gnu org licenses lgpl 3 0"),
    (0.9, "agpl-3", "gnu", "https? (?:www )?gnu org licenses agpl 3 0"),
    (0.9, "gfdl-1.3", "gnu", "https? (?:www )?gnu org licenses fdl 1 3"),
    (0.9, "mpl-2", "mozilla", "https? (?:www )?mozilla org (?:en us )?mpl 2 0"),
    (0.9, "bsl-1", "boost", "https? (?:www )?boost org license 1 0"),
    (0.9, "ofl-1.1", "ofl", "https? scripts sil org ofl"),
    (0.9, "unlicense", "unlicense", "https? (?:www )?unlicense org"),
    (0.9, "cc0-1", "publicdomain", "https? (?:www )?creativecommons org publicdomain zero 1 0"),
    (0.9, "cc-by", "creativecommons", "https? (?:www )?creativecommons org licenses by [1-4] [05]"),
    (0.9, "cc-by-sa", "creativecommons", "https? (?:www )?creativecommons org licenses by sa [1-4] [05]"),
    (0.9, "cc-by-nd", "creativecommons", "https? (?:www )?creativecommons org licenses by nd [1-4] [05]"),
    (0.9, "cc-by-nc", "creativecommons", "https? (?:www )?creativecommons org licenses by nc [1-4] [05]"),
    (0.9, "cc-by-nc-sa", "creativecommons", "https? (?:www )?creativecommons org licenses by nc sa [1-4] [05]"),
    (0.9, "cc-by-nc-nd", "creativecommons", "https? (?:www )?creativecommons org licenses by nc nd [1-4] [05]"),
    # licenses that are rarely given in a phrase
    (0.8, "ecl-2", "educational", "educational community license(?: version)? 2(?: 0)?"),
    (0.8, "lppl-1.3", "latex", "latex project public license(?: version 1 3[ac]?)?"),
    (0.8, "qpl-1", "public", "q public license(?: version)? 1(?: 0)?"),
    (0.8, "ipl-1", "ibm", "ibm public license(?: version)? 1(?: 0)?"),
    (0.8, "cpl-1", "common", "common public license(?: version)? 1(?: 0)?"),
    (0.8, "apsl-2", "apple", "apple public source license(?: version)? 2(?: 0)?"),
    (0.8, "w3c", "w3c", "w3c software (?:and document )?(?:notice and )?license"),
    (0.8, "upl-1", "universal", "universal permissive license(?: v| version)? 1(?: 0)?"),
    (0.8, "mulanpsl-2", "mulan", "mulan (?:psl|permissive software license)(?: v| version)? ?2"),
    (0.8, "cecill-2.1", "cecill", "cecill(?: license| licence)?(?: v| version)? 2 1"),
    (0.8, "ogl-3", "government", "open government licen[cs]e(?: v| version)? ?3(?: 0)?"),
    (0.8, "cdla-permissive-2", "community", "community data license agreement permissive(?: version)? 2(?: 0)?"),
    (0.8, "pddl-1", "dedication", "open data commons public domain dedication and licen[cs]e"),
    (0.8, "odc-by-1", "commons", "open data commons attribution licen[cs]e"),
]


def rules() -> list[tuple[int, float, str, str, str, bool]]:
    """(priority, confidence, label, keyword, pattern, base) of every rule, in order of precedence."""
    out = [(0, 0.9, label, phrase.split()[0], phrase, True) for phrase, label in BASE]
    out += [(1, confidence, label, keyword, pattern, False) for confidence, label, keyword, pattern in BODIES]
    for priority, confidence, phrase in PHRASES:
        for label, keyword, name, alone in NAMES:
            if priority < 6 or alone:
                out.append((priority, confidence, label, keyword, phrase.replace("N", f"(?:{name})", 1), False))
    return out


#: Any of these is in every text that a rule can match; the prefilter sees raw texts.
_W, _N = r"[0-9A-Za-z\x80-\x{10FFFF}]", r"[^0-9A-Za-z\x80-\x{10FFFF}]+"
PREFILTER = (
    rf"(?i)(?<!{_W})(?:(?:un)?licen[cs]|spdx{_N}|(?:gnu{_N})?[al]?gpl|gnu{_N}|apache|(?:free|0)?bsd|mpl|mozilla{_N}|cddl|wtfpl|eupl|osl{_N}|cc0|odbl|sspl|busl|gfdl|mit{_N}(?:no{_N}att|0)|creative{_N}commons|cc{_N}by"
    rf"|permission{_N}(?:is{_N}hereby|to{_N}use)|redistribution{_N}and{_N}use|everyone{_N}is{_N}permitted|free{_N}and{_N}unencumbered"
    rf"|neither{_N}the{_N}name|advertising{_N}materials|altered{_N}source|origin{_N}of{_N}this|this{_N}deed|deal{_N}with{_N}the{_N}software|except{_N}as{_N}contained|product{_N}includes|psf{_N}is|scripts{_N}sil"
    rf"|not{_N}provide{_N}the{_N}software|making{_N}the{_N}functionality|used{_N}for{_N}good|retain{_N}this{_N}notice|perl{_N}itself|public{_N}domain|publicdomain{_N}zero|mulan{_N}psl|cecill(?!{_W})"
    rf"|(?:2|3|4|new|revised|modified|simplified|original|zero){_N}(?:clause{_N})?bsd|(?:under|to){_N}(?:the{_N})?(?:(?:terms|conditions){_N}(?:and{_N}|of{_N})"
    rf"|(?:mit|x11|isc|ncsa|university{_N}of|zlib|postgresql|eclipse|artistic|boost|python|psf|php|openssl|microsoft|open{_N}software|academic|sil|ofl|elastic)(?!{_W})))"
)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(text: Column) -> Column:
    """Number of words; the pieces between separators less an empty first and last one."""
    count = lambda a: F.size(a) - F.when(a[0] == "", 1).otherwise(0) - F.when((F.size(a) > 1) & (F.element_at(a, -1) == ""), 1).otherwise(0)
    return F.transform(F.array(F.split(text, SEPARATOR, -1)), count)[0].cast("long")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _intervals(line: Column, rule: Column) -> Column:
    """Matches of a rule as (priority, confidence, label, base, s, e): words s..e-1."""
    pattern = F.concat(F.lit(" (?:"), rule["pattern"], F.lit(")(?= )"))
    hits = F.regexp_extract_all(line, pattern, F.lit(0))
    gaps = F.transform(F.split(line, pattern, -1), _spaces)
    sizes = F.transform(hits, _spaces)
    start = lambda i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)
    one = lambda m, i: F.struct(rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["label"].alias("label"), rule["base"].alias("base"), start(i).cast("long").alias("s"), (start(i) + _spaces(m)).cast("long").alias("e"))
    return F.transform(hits, one)


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, and detections: array of (priority, confidence, label, base, s, e) after suppression."""
    docs = docs.drop("n_words", "detections")
    plain, text = numbered(docs), F.coalesce(F.col(f"c{docs.columns.index(text_col)}"), F.lit(""))
    table_ = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(lb).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern"), F.lit(b).alias("base")) for p, c, lb, k, x, b in rules()])
    words = F.regexp_extract_all(F.translate(text, _UP, _LOW), F.lit(WORD), F.lit(0))
    line = F.when(text.rlike(PREFILTER), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    out = plain.withColumn("n_words", word_count(text)).withColumn("_line", line)
    found = F.flatten(F.transform(F.filter(table_, lambda r: F.contains(F.col("_line"), r["keyword"])), lambda r: _intervals(F.col("_line"), r)))
    out = out.withColumn("_all", F.when(F.col("_line").isNotNull(), found))
    size = lambda x: x["e"] - x["s"]
    over = lambda y, x: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & ((y["priority"] < x["priority"]) | ((y["priority"] == x["priority"]) & (size(y) > size(x))))
    kept = F.filter("_all", lambda x: x["base"] | ~F.exists(F.col("_all"), lambda y: over(y, x)))
    none = F.expr("filter(array(struct(0 as priority, 0.0D as confidence, '' as label, false as base, 0L as s, 0L as e)), x -> false)")
    return out.withColumn("detections", F.coalesce(kept, none)).drop("_line", "_all").toDF(*docs.columns, "n_words", "detections")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda x: x["base"])
    label = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["s"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("detections")).alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
    )
