"""Licence scan: digests of canonical texts, joined with the digests of known licences.

A text is reduced to a canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything
but letters and digits one space. Its digest is looked up, as a whole, in the table of known licences by a hash
join. So is the digest of each of its lines (notices), and of each run of successive paragraphs (parts between blank
lines) that has the length of a known text: a licence may be wrapped as it likes, and stand inside of a larger
document. Runs are found by the places where paragraphs begin and end, so their number of paragraphs does not
matter. Only pieces of such a length are hashed. The table is part of this module (texts, and digests of
long ones; with the licence's title before the text or without it) or given by the caller, and is broadcast
only up to ``BROADCAST_ROWS`` rows.

Defined cases: a null text is empty and matches nothing; blank lines are no notices; lines without a letter or digit
count as blank; rows with equal doc_id and text have one result each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000

# Texts of common licences and the notices that refer to them.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("reserved", "All rights reserved."),
)
# Titles that may stand before a licence's text.
TITLES = (
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("ISC", "The ISC License"), ("0BSD", "BSD Zero Clause License"), ("0BSD", "Zero-Clause BSD"), ("Zlib", "zlib License"), ("Zlib", "The zlib License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "The 2-Clause BSD License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "The 3-Clause BSD License"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
)
# Length and SHA-256 of the canonical form of licences that are long.
LONG = (
    ("Apache-2.0", 9862, "cf57df1e41c9e24b6e59c0fef155c5ebf9b89a1614e41ec8e280a942a97785a8"),
    ("Artistic-1.0", 5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19581, "890d36e662cb09f33113b55d7d1c753ddc4b0ead994791dfdbdaf4349bb51e36"),
    ("GFDL-1.3", 22017, "ade5f7440f9cc494ee9b2d9d76ef9d5e7528b55ddcc78de4bc94bea8a66d4e50"),
    ("GPL-1.0", 11766, "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", 17118, "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", 33410, "9c475ed1e924fe0f0e64bc816060f8b770d72c9093b2024c63032292abaecc2d"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22340, "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", 14272, "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
)
# Spellings that count as one.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("authorise", "authorize"),
    ("honour", "honor"),
    ("noncommercial", "non-commercial"),
    ("http://", "https://"),
)
COPYRIGHT = r"(^|\n)[ \t]*(copyright[ \t:,]*(\(c\)|©|[0-9])|\(c\)|©)[^\n]*"
APART = r"[^\p{L}\p{N}\n]+"
BLANK = r"\n *\n[\n ]*"


def _base(text: Column) -> Column:
    """The canonical form with its line feeds."""
    x = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for other, one in SPELLINGS:
        x = F.replace(x, F.lit(other), F.lit(one))
    return F.regexp_replace(x, APART, " ")


def _even(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[ \n]+", " "))


def canonical(text: Column) -> Column:
    return _even(_base(text))


def known_licenses(spark: SparkSession, texts=KNOWN, long=LONG) -> DataFrame:
    """(digest, size, license) of known texts, with their titles and without, and of long ones; each digest once."""
    titled = [(name, f"{title}\n\n{text}") for name, text in texts for other, title in TITLES if other == name and len(text) > 200]
    rows = spark.createDataFrame([*texts, *titled], "license string, text string").select("license", canonical(F.col("text")).alias("c"))
    rows = rows.select(F.sha2("c", 256).alias("digest"), F.length("c").alias("size"), "license")
    rows = rows.unionAll(spark.createDataFrame([(d, n, name) for name, n, d in long], rows.schema)) if long else rows
    return rows.groupBy("digest").agg(F.min("size").alias("size"), F.min("license").alias("license"))


def scan(docs: DataFrame, texts=KNOWN, long=LONG) -> DataFrame:
    """(doc_id, digest, license, notices, n_notices, contained) of every row: ``license`` if the whole text is a known one,
    ``notices`` the names that whole lines refer to, joined by commas, and the number of such lines, ``contained``
    the names of known texts that are runs of its paragraphs."""
    known = known_licenses(docs.sparkSession, texts, long)
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # of the known texts
    if len(texts) + len(long) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), _base(text).alias("base"))
    rows = rows.select("doc_id", "text_key", _even(F.col("base")).alias("whole"), F.split("base", "\n").alias("lines"), F.transform(F.split("base", BLANK), _even).alias("p"))
    # the canonical text is its paragraphs joined by spaces: where each of them ends, and where it begins
    n = F.transform(F.filter("p", lambda x: x != ""), lambda x: F.length(x))
    ends = F.aggregate(n, F.array(F.lit(-1)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + 1 + x)))
    rows = rows.withColumn("p", ends).withColumns({"starts": F.transform(F.slice("p", 1, F.size("p") - 1), lambda e: e + 1), "ends": F.slice("p", 2, F.size("p"))})

    def runs_of(size: int) -> Column:
        met = F.array_intersect(F.transform("starts", lambda x: x + size), F.col("ends"))
        return F.when(F.length("whole") >= size, F.transform(met, lambda e: F.substring(F.col("whole"), e - size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    piece = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("piece"))
    lines = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: F.length(x).isin(sizes))
    runs = F.concat(*[runs_of(size) for size in sizes])
    # one row for the whole text, and one for each piece that is as long as a known text
    pieces = F.concat(F.transform(F.array("whole"), piece("whole")), F.transform(lines, piece("line")), F.transform(runs, piece("run")))
    rows = rows.select("doc_id", "text_key", F.explode(pieces).alias("x")).select("doc_id", "text_key", "x.kind", F.sha2("x.piece", 256).alias("digest"))
    rows = rows.join(known.select("digest", "license"), "digest", "left")
    of = lambda kind: (F.col("kind") == kind) & F.col("license").isNotNull()
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(of(kind), F.col("license")))), ",")
    is_whole = F.col("kind") == "whole"
    found = rows.groupBy("doc_id", "text_key").agg(
        F.max(F.when(is_whole, F.col("digest"))).alias("digest"), F.max(F.when(of("whole"), F.col("license"))).alias("license"), names("line").alias("notices"),
        F.count_if(of("line")).alias("hits"), F.count_if(is_whole).alias("copies"), names("run").alias("contained"),
    )
    one = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))  # rows with equal doc_id and text
    return found.select("doc_id", "digest", "license", "notices", (F.col("hits") / F.col("copies")).cast("long").alias("n_notices"), "contained", one.alias("copy")).drop("copy")


def _sql() -> str:
    def base(x: str) -> str:
        x = rf"regexp_replace(lower({x}), '{COPYRIGHT}', '', 'g')"
        for other, one in SPELLINGS:
            x = f"replace({x}, '{other}', '{one}')"
        return rf"regexp_replace({x}, '{APART}', ' ', 'g')"

    even = lambda x: rf"trim(regexp_replace({x}, '[ \n]+', ' ', 'g'))"
    values = [*KNOWN, *((name, f"{title} {text}") for name, text in KNOWN for other, title in TITLES if other == name and len(text) > 200)]
    texts = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in values)
    digests = ", ".join(f"('{name}', '{d}')" for name, _, d in LONG)
    sizes = f"select length({even(base('text'))}) from (values {texts}) v(license, text) union select n from (values {', '.join(f'({n})' for _, n, _ in LONG)}) w(n)"
    return f"""
with k as (select digest, min(license) as license from (select sha256({even(base('text'))}) as digest, license from (values {texts}) v(license, text) union all select digest, license from (values {digests}) w(license, digest)) group by 1),
d as (select doc_id, coalesce(text, '') as text, {base("coalesce(text, '')")} as base from (select distinct doc_id, text from documents)),
l as (select doc_id, text, generate_subscripts(string_split(base, chr(10)), 1) as i, unnest(string_split(base, chr(10))) as line from d),
n as (select doc_id, text, string_agg(distinct license, ',' order by license) as notices, count(distinct i) as n_notices
      from l join k on sha256(trim(line)) = k.digest group by doc_id, text),
p as (select doc_id, text, unnest(ps) as par, generate_subscripts(ps, 1) as i from (select doc_id, text, regexp_split_to_array(base, '{BLANK}') as ps from d)),
a as (select doc_id, text, i, {even('par')} as par from p),
b as (select doc_id, text, i, sum(length(par) + 1) over (partition by doc_id, text order by i) as after, length(par) as n from a where par <> ''),
w as (select doc_id, text, string_agg(par, ' ' order by i) as whole from a where par <> '' group by doc_id, text),
r as (select x.doc_id, x.text, substring(w.whole, (x.after - x.n)::bigint, (y.after - 1 - x.after + x.n + 1)::bigint) as run
  from b x join b y on x.doc_id = y.doc_id and x.text = y.text and y.i >= x.i join w on w.doc_id = x.doc_id and w.text = x.text
  where y.after - x.after + x.n in ({sizes})),
c as (select r.doc_id, r.text, string_agg(distinct license, ',' order by license) as contained from r join k on sha256(r.run) = k.digest group by r.doc_id, r.text)
select e.doc_id, sha256({even('d.base')}) as digest, k.license, coalesce(n.notices, '') as notices, coalesce(n.n_notices, 0) as n_notices, coalesce(c.contained, '') as contained
from documents e join d on d.doc_id = e.doc_id and d.text = coalesce(e.text, '') left join k on sha256({even('d.base')}) = k.digest
left join n on n.doc_id = d.doc_id and n.text = d.text left join c on c.doc_id = d.doc_id and c.text = d.text
"""


SQL = _sql()
