"""License scans: text units against license templates by the Dice coefficient over word bigrams.

Units are the lines, the paragraphs of more than one line and the whole text; lines that start with ``copyright``
are left out of the longer ones. Text is lower-cased and every run of other signs than ``a-z0-9`` is a gap. A unit
and a template are compared over their distinct bigrams, ``2 |A and B| / (|A| + |B|)`` in thousandths, when their
sizes allow the threshold: ``|A|`` must lie between ``t / (2 - t)`` and ``(2 - t) / t`` times ``|B|``. A unit that
reaches the threshold with a template shares at least ``t / (2 - t)`` of its bigrams; texts without the words which
that takes are passed over after a search for those words.

All of it is column expressions inside the scan, without an exchange. Null and empty texts have no units. A unit
names the best template, ties the smaller name; repeated rows repeat their result; extra columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient, in thousandths.
THRESHOLD = 800
#: Most bigrams of a template whose words are all looked for in the first test.
SHORT = 12

# Public license texts, without their copyright lines.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. " + _WARRANTY
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
# End of fixed values.


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def may_match(low: Column, templates: dict[str, str], threshold: int = THRESHOLD) -> Column:
    """A test of the lower-cased text that every text with a matching unit passes.

    A matching unit has ``need`` of a template's bigrams. The words of a template form a connected chain, so ``x``
    missing words break at least ``x`` bigrams: all but ``bigrams - need`` of the words must be there. For templates
    of more than ``SHORT`` bigrams a few long words are asked for instead, chosen so that fewer than ``need`` bigrams
    have none of them.
    """
    passed, markers = F.lit(False), []
    for _, text in sorted(templates.items()):
        grams = bigrams(text)
        need = -(-threshold * len(grams) // (2000 - threshold))
        if len(grams) <= SHORT:
            there = [F.when(low.contains(w), 1).otherwise(0) for w in dict.fromkeys(words(text))]
            passed = passed | (sum(there[1:], there[0]) >= len(there) - (len(grams) - need))
            continue
        for w in sorted(set(words(text)), key=lambda w: (-len(w), w)):
            if sum(not set(g.split()) & set(markers) for g in grams) < need:
                break
            markers += [w] if w not in markers else []
    for w in markers:
        passed = passed | low.contains(w)
    return passed


def scan(documents: DataFrame, templates: dict[str, str] | None = None, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, found``: array of ``unit, license, dice``, one for each unit that reaches the threshold."""
    templates = templates or TEMPLATES
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    marked = may_match(F.col("_low"), templates, threshold)
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, bigrams(t))).alias("grams")) for n, t in sorted(templates.items())))
    norm = "trim(both ' ' from regexp_replace(regexp_replace(_low, '[^a-z0-9\\n]+', ' '), ' ?\\n ?', '\\n'))"
    long = "filter(split({}, '\\n'), l -> l != '' and l not like 'copyright%')"
    units = (
        "filter(array_distinct(concat(split(_norm, '\\n'), "
        f"transform(split(_norm, '\\n\\n+'), p -> array_join({long.format('p')}, ' ')), array(array_join({long.format('_norm')}, ' ')))), u -> u != '')"
    )
    grams = "array_distinct(transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> concat(x, ' ', w[i + 1])))"
    best = (
        f"array_max(transform(filter(_known, t -> size(u.grams) * {2000 - threshold} >= size(t.grams) * {threshold} and size(u.grams) * {threshold} <= size(t.grams) * {2000 - threshold}), "
        "t -> struct(2000 * size(array_intersect(u.grams, t.grams)) div (size(u.grams) + size(t.grams)) as dice, -array_position(_names, t.name) as rank)))"
    )
    out = documents.select(F.struct(F.col(key)).alias("_row"), low.alias("_low"))
    out = out.withColumn("_known", known).withColumn("_names", F.array(*(F.lit(n) for n in sorted(templates))))
    out = out.withColumn("_norm", F.when(marked, F.expr(norm)).otherwise(F.lit("")))
    out = out.withColumn("_units", F.expr(f"transform({units}, u -> named_struct('unit', u, 'w', split(u, ' ')))"))
    out = out.withColumn("_grams", F.expr(f"transform(transform(_units, u -> u.w), w -> {grams})"))
    out = out.withColumn("_pairs", F.expr("filter(zip_with(_units, _grams, (u, g) -> named_struct('unit', u.unit, 'grams', g)), u -> size(u.grams) > 0)"))
    out = out.withColumn("_best", F.expr(f"transform(_pairs, u -> named_struct('unit', u.unit, 'best', {best}))"))
    found = f"transform(filter(_best, b -> b.best.dice >= {threshold}), b -> named_struct('unit', b.unit, 'license', _names[cast(-b.best.rank as int) - 1], 'dice', cast(b.best.dice as int)))"
    return out.select(F.col(f"_row.{key}"), F.expr(found).alias("found"))


def license_report(documents: DataFrame) -> DataFrame:
    """The columns of query ``op4_licenses``: units found, licenses (sorted, comma-joined) and the best coefficient."""
    found = scan(documents)
    return found.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_units"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        F.array_max("found.dice").alias("best_dice"),
    )


def _sql() -> str:
    known = ", ".join("('{}', ['{}'])".format(n, "', '".join(bigrams(t))) for n, t in sorted(TEMPLATES.items()))
    long = "array_to_string(list_filter(string_split({}, chr(10)), lambda l: l <> '' AND NOT starts_with(l, 'copyright')), ' ')"
    return f"""
WITH t(name, grams) AS (VALUES {known}),
n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ') AS x FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(x, chr(10)),
        list_transform(regexp_split_to_array(x, '\\n\\n+'), lambda p: {long.format('p')}), [{long.format('x')}])) AS unit FROM n),
w AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM u WHERE unit <> ''),
g AS (SELECT doc_id, unit, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, unit, name, 2000 * len(list_intersect(g.grams, t.grams)) // (len(g.grams) + len(t.grams)) AS dice FROM g, t),
b AS (SELECT doc_id, unit, max(dice) AS dice, arg_min(name, (-dice, name)) AS name FROM d WHERE dice >= {THRESHOLD} GROUP BY ALL)
SELECT doc_id, count(b.unit) AS n_units, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses, CAST(max(dice) AS INTEGER) AS best_dice
FROM documents LEFT JOIN b USING (doc_id) GROUP BY doc_id
"""


SQL = _sql()
