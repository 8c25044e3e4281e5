"""Licence scan by canonical digests of whole texts.

A text and every known licence are brought to one canonical form: lower case,
without lines that state a copyright holder, with one spelling for words that are spelled in
several ways, and with every run of other characters than letters and digits
as one space. The SHA-256 of that form is joined by equality to the digests of
the known licences (``match_licenses``: only whole texts match).

``scan_licenses`` finds licences inside longer texts as well: one line, one
paragraph or many. Each known form is a print: its first words, its length and
its digest. Wherever the first words stand in a text's form, the next
characters of that length are digested and held against the print. A text with
copyright lines is looked at with and without them, so that a copyright line
between two parts hides none.

Defined results: null, empty and blank texts have the digest of the empty form
and match nothing; repeated rows match alike; two known licences with one
canonical form are reported as the one that sorts first; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, the second is the canonical one.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("http", "https"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Lines that state a holder: "copyright" with its sign, a year or a blank to fill in; a line that merely begins with the word is text.
#: The lines end at line feeds only; both regular-expression engines that read it agree on the rest.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n(©]*(?:(?:copyright[ \t]*(?:\(c\)|©|:|\d|[\[<{])|\(c\)[ \t]*(?:copyright|\d)|©)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
OTHER = r"[^\p{L}\p{N}]+"

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_BOOST = "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

#: Known licence texts and notices, by SPDX identifier. Callers may pass more.
KNOWN = (
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSL-1.0", _BOOST),
    ("BSD-2-Clause", f"{_REDISTRIBUTION}\n\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTION}\n{_ENDORSEMENT}\n\n{_BSD_AS_IS}"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", f"{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT", f"MIT License\n\n{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Zlib", _ZLIB),
    ("MIT-0", f"MIT No Attribution\n\n{_PERMISSION}.\n\n{_AS_IS}"),
)


#: Words that a print starts with.
ANCHOR_WORDS = 6

#: Prints of full licence texts, from the first common sentence to the end of the terms.
#: The text does not say whether later versions are allowed: GNU licences are named "only".
FULL_TEXTS: tuple[tuple[str, str, int, str], ...] = (
    ("Apache-2.0", "terms and conditions for use reproduction", 8774, "d7dd8e5c661e35d656a43688fc21624b0ba52216e4c419c747129bf83780d165"),
    ("CC0-1.0", "statement of purpose the laws of", 6182, "4f8ab63ace774f37529081c81e2730a88143bf70e67392bd3c3701bd0a175152"),
    ("GPL-2.0-only", "everyone is permitted to copy and", 14353, "efe85a3095e5f8fde7280f5ea5602c1fa24e66ee3a32d2eae38b3b1ac2196ee4"),
    ("GPL-3.0-only", "everyone is permitted to copy and", 30890, "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2"),
    ("LGPL-2.0-only", "everyone is permitted to copy and", 22138, "936eb024285b788f0eddbf96826d70da1adefa3099b0ec5336ffe495c00b7798"),
    ("LGPL-2.1-only", "everyone is permitted to copy and", 23221, "f0b3313d45a8a467f987a040dc16addaea95621fdaededc28db994fccd572d0e"),
    ("LGPL-3.0-only", "everyone is permitted to copy and", 7047, "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("MPL-1.1", "1 definitions 1 0 1 commercial", 20977, "4fbf4b1f3d8cf5d05e627fcb1b0dded60f72dbb2e5c2bc5bb929a8db71982f2d"),
    ("MPL-2.0", "1 definitions 1 1 contributor means", 13626, "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3"),
)

#: Digests of the canonical forms of whole licence files as published.
WHOLE_TEXTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "45c5565dedc03ff2a570c67c5af611f8a3d0a0227c6e81d9fb11fbf0c004b959"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3-only", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0-only", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0-only", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
)



def canonical(text: Column) -> Column:
    """The canonical form of a text; equal forms are the same licence."""
    return _spelled(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"(?md){COPYRIGHT_LINE}", ""))


def _with_copyright(text: Column) -> Column:
    """The same form with the copyright lines; null where there are none."""
    lower = F.lower(text)
    return F.when(lower.rlike(f"(?md){COPYRIGHT_LINE}"), _spelled(lower))


def _spelled(lower: Column) -> Column:
    """Words with one spelling each, one space apart; every word has two blanks of its own meanwhile, so neighbours do not share one."""
    plain = F.concat(F.lit(" "), F.regexp_replace(lower, OTHER, "  "), F.lit(" "))
    for said, meant in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {said.replace(' ', '  ')} "), F.lit(f" {meant.replace(' ', '  ')} "))
    return F.trim(F.replace(plain, F.lit("  "), F.lit(" ")))


def known_licenses(spark: SparkSession, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(license_id, text) of the licences known here and ``extra`` ones."""
    return spark.createDataFrame([*KNOWN, *extra], "license_id string, text string")


def match_licenses(docs: DataFrame, licenses: DataFrame, digests: tuple[tuple[str, str], ...] = WHOLE_TEXTS) -> DataFrame:
    """doc_id, canonical_sha256 and license_id (null if none) of every document, by the digests of ``licenses`` and of other whole texts."""
    known = licenses.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''").select("license_id", F.sha2("form", 256).alias("known_sha256"))
    if digests:
        known = known.unionByName(licenses.sparkSession.createDataFrame(list(digests), "license_id string, known_sha256 string"))
    known = known.groupBy("known_sha256").agg(F.min("license_id").alias("license_id"))
    own = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return own.join(known, own["canonical_sha256"] == known["known_sha256"], "left").drop("known_sha256")


def license_prints(licenses: DataFrame) -> list[tuple[str, str, int, str]]:
    """(license_id, first words, length, digest) of both forms of every licence; as many as the list is long."""
    forms = licenses.select("license_id", F.explode(F.array(canonical(F.col("text")), _with_copyright(F.col("text")))).alias("form"))
    rows = forms.where("form <> ''").distinct().collect()
    return sorted((r.license_id, " ".join(r.form.split(" ")[:ANCHOR_WORDS]), len(r.form), hashlib.sha256(r.form.encode()).hexdigest()) for r in rows)


def scan_licenses(docs: DataFrame, licenses: DataFrame, full_texts: tuple[tuple[str, str, int, str], ...] = FULL_TEXTS) -> DataFrame:
    """doc_id, canonical_sha256 of the whole text and license_id, one row for every licence that the text is or holds, or one with null."""
    prints: dict[str, dict[tuple[int, str], set[str]]] = {}
    for name, anchor, length, digest in (*license_prints(licenses), *full_texts):
        prints.setdefault(f" {anchor} ", {}).setdefault((length, digest), set()).add(name)

    def held(form: str) -> set[str]:
        padded, found = f" {form} ", set()
        for anchor, ends in prints.items():
            open_ends = dict(ends)
            at = padded.find(anchor)
            while at >= 0 and open_ends:
                for length, digest in list(open_ends):
                    stop = at + 1 + length
                    if padded[stop : stop + 1] == " " and hashlib.sha256(padded[at + 1 : stop].encode()).hexdigest() == digest:
                        found |= open_ends.pop((length, digest))
                at = padded.find(anchor, at + 1)
        return found

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held(a.as_py()) | (held(b.as_py()) if b.is_valid else set()) for a, b in zip(batch.column("form"), batch.column("other"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("canonical_sha256"), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=["doc_id", "canonical_sha256", "found"])

    # the form is read twice: without this mark it would be made twice
    formed = docs.select("doc_id", F.explode(F.array(F.struct(canonical(F.col("text")).alias("form"), _with_copyright(F.col("text")).alias("other")))).alias("f"))
    digests = formed.select("doc_id", F.sha2("f.form", 256).alias("canonical_sha256"), "f.form", "f.other")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return digests.mapInArrow(scan, f"doc_id {kind}, canonical_sha256 string, found array<string>").select("doc_id", "canonical_sha256", F.explode_outer("found").alias("license_id"))
