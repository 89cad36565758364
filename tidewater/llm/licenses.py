"""Operator 4: licences in texts, by sentences and ordered rules (DataFrame functions only).

A text is cut into sentences, at their ends and at lines without a letter or digit; each
is lower-cased, and what is not a letter or digit becomes one blank. The first pattern of
``SENTENCES`` that is found in a line of a sentence gives the line's identifier. Patterns
found in the whole sentence but in none of its lines, as it is wrapped, are added in their
places; within a family only the first counts, as in a line. The identifiers of a text, in order, are matched against ``RULES``, in
order; a rule consumes what it matches, so a longer licence comes before its parts.
Identifiers that no rule consumes are reported as rest. An SPDX tag's expression, to the end of its
line, names licences of its own, which follow those of the rules: each term of AND and OR is one,
``-only``, ``-or-later`` and ``+`` are read, an exception after WITH is left out, and what
``SPDX`` doesn't know is given as it is, in lower case.

Only texts with one of ``HINTS`` are cut, or with one that may be wrapped; every pattern
contains one of them. Everything
is a projection: no shuffle, and any text length costs its own row only.

Cases: null and empty texts have no licence; repeated sentences and rows are each
matched; a licence stated twice is listed once; an empty table gives an empty result;
other columns are ignored, whatever their names. The SQL cuts at every newline as well,
so for wrapped sentences it has fewer identifiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Identifiers and patterns of sentences from public licence texts, in order.
SENTENCES = [
    ("spdx", r"^(.* )?spdx license identifier "),
    ("mitGrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included"),
    ("iscGrant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("asIs", r"(software|work) is provided (by the .* )?as is"),
    ("bsdGrant", r"redistribution and use in source and binary forms"),
    ("bsdSource", r"redistributions of source code must retain"),
    ("bsdBinary", r"redistributions in binary form must reproduce"),
    ("bsdEndorse", r"neither the name .* may be used to endorse"),
    ("lgpl", r"gnu (lesser|library) general public licen[cs]e"),
    ("agpl3", r"gnu affero general public licen[cs]e"),
    ("gplLater", r"(version [23] of the licen[cs]e or|gnu general public licen[cs]e .*) (at your option )?any later version"),
    ("gpl3", r"gnu general public licen[cs]e version 3|\bgpl ?v?3\b.*licen[cs]e"),
    ("gpl2", r"gnu general public licen[cs]e version 2|\bgpl ?v?2\b.*licen[cs]e"),
    ("gpl", r"gnu general public licen[cs]e"),
    ("apache2", r"apache licen[cs]e( version)? 2 0"),
    ("mpl2", r"mozilla public licen[cs]e (v|version )?2 0"),
    ("epl", r"eclipse public licen[cs]e"),
    ("mitName", r"\bmit licen[cs]e\b"),
    ("bsdName", r"\bbsd licen[cs]e\b|\b[234] clause bsd\b.*licen[cs]e"),
    ("ccByNcSa", r"licen[cs]ed .*\bcc by nc sa\b"),
    ("ccByNcNd", r"licen[cs]ed .*\bcc by nc nd\b"),
    ("ccByNc", r"licen[cs]ed .*\bcc by nc\b"),
    ("ccBySa", r"licen[cs]ed .*\bcc by sa\b|creative commons attribution sharealike .*licen[cs]e"),
    ("ccByNd", r"licen[cs]ed .*\bcc by nd\b"),
    ("ccBy", r"licen[cs]ed .*\bcc by\b|creative commons attribution .*licen[cs]e"),
    ("cc0", r"\bcc0\b.*licen[cs]e|dedicated to the public domain"),
    ("unlicense", r"released into the public domain"),
    ("allRights", r"all rights reserved"),
    ("copyright", r"^(.* )?copyright (c )?[0-9]{4}"),
    ("otherLicense", r"licen[cs]ed under|released under .* licen[cs]e"),
]
#: Licences and the sequences of identifiers that state them, in order.
RULES = [
    ("BSD-3-Clause", r"((copyright,)?allRights,)?bsdGrant,bsdSource,bsdBinary,bsdEndorse(,asIs)?"),
    ("BSD-2-Clause", r"((copyright,)?allRights,)?bsdGrant,bsdSource,bsdBinary(,asIs)?"),
    ("MIT", r"mitGrant(,mitNotice)?(,asIs)?"),
    ("ISC", r"iscGrant(,asIs)?"),
    ("AGPL-3.0", r"agpl3"),
    ("LGPL", r"lgpl"),
    ("GPL-or-later", r"(gpl3,|gpl2,|gpl,)?gplLater"),
    ("GPL-3.0", r"gpl3"),
    ("GPL-2.0", r"gpl2"),
    ("GPL", r"gpl"),
    ("Apache-2.0", r"apache2"),
    ("MPL-2.0", r"mpl2"),
    ("EPL", r"epl"),
    ("MIT", r"mitName"),
    ("BSD", r"bsdName"),
    ("CC-BY-NC-SA", r"ccByNcSa"),
    ("CC-BY-NC-ND", r"ccByNcNd"),
    ("CC-BY-NC", r"ccByNc"),
    ("CC-BY-SA", r"ccBySa"),
    ("CC-BY-ND", r"ccByNd"),
    ("CC-BY", r"ccBy"),
    ("CC0-1.0", r"cc0"),
    ("Unlicense", r"unlicense"),
    ("Proprietary", r"(copyright,)?allRights"),
    ("Other", r"otherLicense"),
]
#: Licences and the terms of SPDX expressions that name them, in order.
SPDX = [
    ("MIT", r"mit"),
    ("ISC", r"isc"),
    ("Apache-2.0", r"apache-2\.0"),
    ("BSD-3-Clause", r"bsd-3-clause"),
    ("BSD-2-Clause", r"bsd-2-clause"),
    ("AGPL-3.0", r"agpl-3\.0(-only|-or-later|\+)?"),
    ("LGPL", r"lgpl-[0-9.]+(-only|-or-later|\+)?"),
    ("GPL-or-later", r"gpl-[0-9.]+(-or-later|\+)"),
    ("GPL-3.0", r"gpl-3\.0(-only)?"),
    ("GPL-2.0", r"gpl-2\.0(-only)?"),
    ("GPL", r"gpl-[0-9.]+(-only)?"),
    ("MPL-2.0", r"mpl-2\.0"),
    ("EPL", r"epl-[0-9.]+"),
    ("CC-BY-NC-SA", r"cc-by-nc-sa-[0-9.]+"),
    ("CC-BY-NC-ND", r"cc-by-nc-nd-[0-9.]+"),
    ("CC-BY-NC", r"cc-by-nc-[0-9.]+"),
    ("CC-BY-SA", r"cc-by-sa-[0-9.]+"),
    ("CC-BY-ND", r"cc-by-nd-[0-9.]+"),
    ("CC-BY", r"cc-by-[0-9.]+"),
    ("CC0-1.0", r"cc0-1\.0"),
    ("Unlicense", r"unlicense"),
]
#: A tag's expression in the lower-cased text, what stands between its terms, and what follows a term.
_TAG, _BETWEEN, _WITH, _EDGES = r"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)", r"[ \t]+(?:or|and)[ \t]+|[()]", r"[ \t]+with[ \t].*$", " \t-."
#: Each pattern above needs one of these in the lower-cased text.
HINTS = ["licen", "permission ", "redistribution", "all rights", "rights reserved", "copyright", "public domain", "as is", "as-is", '"as', "endorse", "spdx"]
#: Repeats of a rule are consumed together.
_PATTERNS = [(name, f"(,{body})+,") for name, body in RULES]
#: A mark that begins a line is a comment's, not a sentence's end.
_CUT, _OTHER = r"(?<=[.!?;])(?<!(?:^|\n)[ \t;]{0,16};)\s+|\n[^\p{L}\p{N}]*\n", r"[^\p{L}\p{N}]+"
_LOOSE = "|".join(x.replace(" ", _OTHER) for x in HINTS)
_OPEN = r"licen[cs]ed under( the)?( terms of)?( the)?$"
#: Of these only the first that a sentence states counts.
FAMILIES = [
    ["lgpl", "agpl3", "gplLater", "gpl3", "gpl2", "gpl"],
    ["ccByNcSa", "ccByNcNd", "ccByNc", "ccBySa", "ccByNd", "ccBy"],
    ["allRights", "copyright"],
]


def _before(name: str) -> list[str]:
    """Identifiers that take the place of ``name`` in a sentence that states both."""
    return [x for x, _ in SENTENCES if x != name] if name == "otherLicense" else [x for f in FAMILIES if name in f for x in f[: f.index(name)]]


_PLACES = {name: i for i, (name, _) in enumerate(SENTENCES)}
_KIND = "array<struct<place:int,id:string>>"


def _list(values: list, kind: str):
    return F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>")


def _flags(text):
    """Which patterns a text states, in their order; each is looked for once."""
    return F.array(*[text.rlike(pattern) for _, pattern in SENTENCES])


def _first(flags):
    """The identifier of the first pattern that is stated."""
    return F.get(_list([x for x, _ in SENTENCES], "string"), F.array_position(flags, True).cast("int") - 1)


def _added(lines, whole):
    """Places and identifiers of what the whole sentence states and no line does."""
    patterns = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("id"), F.lit(p.removeprefix("^(.* )?")).alias("pattern"), _list([_PLACES[x] for x in _before(n)], "int").alias("before")) for i, (n, p) in enumerate(SENTENCES)])
    new = F.filter(
        patterns,
        lambda p: F.get(whole["flags"], p["at"]) & ~F.exists(lines, lambda line: F.get(line["flags"], p["at"])) & ~F.exists(p["before"], lambda i: F.get(whole["flags"], i)),
    )
    return F.transform(new, lambda p: F.struct(F.regexp_instr(whole["plain"], p["pattern"]).alias("place"), p["id"].alias("id")))


def _found(lines, whole):
    """Places and identifiers of lines; a line that ends before the licence's name states none if the sentence goes on with it."""

    def step(state, line):
        name = _first(line["flags"])
        name = F.when(line["hinted"] & ~((name == "otherLicense") & line["plain"].rlike(_OPEN) & (_first(whole["flags"]) != "otherLicense")), name)
        more = F.array(F.struct(state["at"].alias("place"), name.alias("id")))
        found = F.when(name.isNotNull(), F.concat(state["found"], more)).otherwise(state["found"])
        return F.struct((state["at"] + F.length(line["plain"]) + 1).alias("at"), found.alias("found"))

    return F.aggregate(lines, F.struct(F.lit(1).alias("at"), F.array().cast(_KIND).alias("found")), step, lambda x: x["found"])


def _merged(found, added):
    """Identifiers by place, without those of lines that an added one takes the place of."""
    before = F.create_map(*[x for n, _ in SENTENCES if _before(n) for x in (F.lit(n), _list(_before(n), "string"))])
    stays = lambda x: ~F.coalesce(F.arrays_overlap(F.try_element_at(before, x["id"]), F.transform(added, lambda y: y["id"])), F.lit(False))
    return F.transform(F.array_sort(F.concat(F.filter(found, stays), added)), lambda x: x["id"])


def _stated(raw):
    """Identifiers of a sentence, in order: those of its lines, and those that its lines state together."""
    plain = lambda x: F.trim(F.regexp_replace(x, _OTHER, " "))
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.struct(x.rlike("|".join(HINTS)).alias("hinted"), plain(x).alias("plain"))), lambda x: x["plain"] != "")
    # As elements of arrays they are computed once.
    flagged = F.transform(lines, lambda x: F.struct(x["hinted"].alias("hinted"), x["plain"].alias("plain"), _flags(x["plain"]).alias("flags")))
    joined = F.transform(F.array(flagged), lambda x: F.struct(x.alias("lines"), F.array_join(F.transform(x, lambda y: y["plain"]), " ").alias("plain")))
    both = F.transform(joined, lambda x: F.struct(x["lines"].alias("lines"), F.struct(x["plain"].alias("plain"), F.when(F.size(x["lines"]) > 1, _flags(x["plain"])).otherwise(F.get(x["lines"], 0)["flags"]).alias("flags")).alias("whole")))
    parts = F.transform(both, lambda x: F.struct(_found(x["lines"], x["whole"]).alias("found"), F.when(F.size(x["lines"]) > 1, _added(x["lines"], x["whole"])).otherwise(F.array().cast(_KIND)).alias("added")))
    return F.flatten(F.transform(parts, lambda x: F.when(F.size(x["added"]) > 0, _merged(x["found"], x["added"])).otherwise(F.transform(x["found"], lambda y: y["id"]))))


def _tagged(low):
    """Licences of the SPDX tags of a lower-cased text, in order."""
    terms = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(_TAG), 1), lambda x: F.split(x, _BETWEEN)))
    terms = F.filter(F.transform(terms, lambda x: F.btrim(F.regexp_replace(F.btrim(x, F.lit(_EDGES)), _WITH, ""), F.lit(_EDGES))), lambda x: x != "")

    def name(term):
        out = None
        for known, pattern in SPDX:
            test = term.rlike(f"^(?:{pattern})$")
            out = F.when(test, known) if out is None else out.when(test, known)
        return out.otherwise(term)

    return F.array_distinct(F.transform(terms, name))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with _tw_sentences (identifiers in order), _tw_licenses and _tw_rest."""
    low = F.lower(F.col(text_col))
    hinted = F.lit(False)
    for x in HINTS:
        hinted = hinted | F.contains(low, F.lit(x))
    hinted = hinted | low.rlike(_LOOSE)
    ids = F.flatten(F.transform(F.filter(F.split(low, _CUT), lambda x: x.rlike(_LOOSE)), _stated))
    out = docs.withColumn("_tw_sentences", F.when(F.coalesce(hinted, F.lit(False)), ids).otherwise(F.array().cast("array<string>")))
    rest = F.concat(F.lit(","), F.array_join("_tw_sentences", ","), F.lit(","))
    stated = out.withColumn("_tw_rest", F.when(F.size("_tw_sentences") > 0, rest)).withColumn("_tw_licenses", F.array().cast("array<string>"))
    found, left = F.col("_tw_licenses"), F.col("_tw_rest")
    step = F.struct(found.alias("found"), left.alias("rest"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in _PATTERNS])

    def apply(state, rule):
        hit = F.regexp_like(state["rest"], rule["pattern"])
        return F.when(
            hit, F.struct(F.array_union(state["found"], F.array(rule["name"])).alias("found"), F.regexp_replace(state["rest"], rule["pattern"], F.lit(",")).alias("rest"))
        ).otherwise(state)

    done = F.when(left.isNotNull(), F.aggregate(rules, step, apply)).otherwise(step)
    stated = stated.withColumn("_tw_done", done)
    tags = F.when(F.array_contains("_tw_sentences", "spdx"), _tagged(low)).otherwise(F.array().cast("array<string>"))
    rest = F.filter(F.split(F.coalesce("_tw_done.rest", F.lit("")), ","), lambda x: ~x.isin("", "spdx"))
    return stated.withColumns({"_tw_licenses": F.array_union("_tw_done.found", tags), "_tw_rest": rest}).drop("_tw_done")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("_tw_sentences").cast("long").alias("n_sentences"),
        F.array_join("_tw_sentences", ",").alias("sentence_ids"),
        F.array_join("_tw_licenses", ",").alias("licenses"),
        F.array_join("_tw_rest", ",").alias("unmatched_ids"),
    )


def _oracle() -> str:
    case = "case " + " ".join(f"when regexp_matches(x, '{p}') then '{n}'" for n, p in SENTENCES) + " end"
    hints = "|".join(HINTS)
    steps, last = [], "s0"
    for i, (name, pattern) in enumerate(_PATTERNS, 1):
        steps.append(
            f"s{i} as (select doc_id, ids, tags, case when regexp_matches(rest, '{pattern}') and not list_contains(found, '{name}') then list_append(found, '{name}') else found end as found, "
            f"regexp_replace(rest, '{pattern}', ',', 'g') as rest from {last})"
        )
        last = f"s{i}"
    known = "case " + " ".join(f"when regexp_full_match(x, '{p}') then '{n}'" for n, p in SPDX) + " else x end"
    edges = "' ' || chr(9) || '-.'"
    return f"""
with p as (select doc_id, lower(text) as low, string_split(regexp_replace(lower(text), '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10)) as pieces from documents),
n as (select doc_id, low, list_transform(list_filter(pieces, lambda x: regexp_matches(x, '{hints}')), lambda x: trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) as sentences from p),
i as (select doc_id, low, coalesce(list_filter(list_transform(sentences, lambda x: {case}), lambda x: x is not null), []) as ids from n),
t as (select doc_id, ids, case when list_contains(ids, 'spdx') then
        list_filter(list_transform(flatten(list_transform(regexp_extract_all(low, '{_TAG}', 1), lambda x: string_split_regex(x, '{_BETWEEN}'))),
                                   lambda x: trim(regexp_replace(trim(x, {edges}), '{_WITH}', ''), {edges})), lambda x: x <> '') else [] end as terms from i),
g as (select doc_id, ids, list_transform(terms, lambda x: {known}) as tags from t),
s0 as (select doc_id, ids, tags, cast([] as varchar[]) as found, ',' || array_to_string(ids, ',') || ',' as rest from g),
{", ".join(steps)},
a as (select doc_id, ids, rest, list_concat(found, tags) as found from {last})
select doc_id, cast(len(ids) as bigint) as n_sentences, array_to_string(ids, ',') as sentence_ids,
       array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') as licenses,
       array_to_string(list_filter(string_split(rest, ','), lambda x: x not in ('', 'spdx')), ',') as unmatched_ids
from a
"""


ORACLE_SQL = _oracle()
