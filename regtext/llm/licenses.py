"""Operator 5, licence scan by canonical digest (DataFrame functions only).

A text is normalised (lower case, copyright lines dropped, equivalent spellings made one, punctuation
and spacing made single blanks) and digested. Known licences go through the same steps. Every unit of
a document is looked up whole by a hash join on the digest: the entire document, every block between
blank lines and every line. Units that differ from a known text in wording match nothing.

The known table is a parameter; the built-in one holds short texts and notices. Only the units' digests
meet it, texts are never shuffled, and the join strategy is left to the optimiser.

Defined cases: NULL, blank and punctuation-only texts and units match nothing; a document that equals
its only block or line reports every scope that matches; repeated rows add up in ``n``; NULL ids form one
document; known texts that normalise alike report every name; an empty table on either side gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, or_empty

# Spellings that licence matching treats as equal (left is replaced by right).
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisation", "capitalization"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil ", "fulfill "),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("non-commercial", "noncommercial"), ("per cent", "percent"), ("sub-license", "sublicense"), ("https://", "http://"),
)

# Known short licence texts and notices (public texts).
_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
             "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
             "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_TAIL = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
             "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
             "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
             "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
             "THIS SOFTWARE.")
_BSD_TAIL = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
             "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
             "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
             "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
             "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
             "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
             "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
             "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
             "distribution.\n")
_BSD_NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.\n")
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted.\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
                   "specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)


# Title lines that often stand above a full text.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License",
          "BSD-3-Clause": "BSD 3-Clause License"}


def known_rows() -> list[tuple[str, str]]:
    """The known texts, the full ones (more than a line) also under their title."""
    return [*KNOWN, *((name, f"{TITLES[name]}\n\n{text}") for name, text in KNOWN if name in TITLES and "\n" in text)]


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_rows(), "license string, text string")


def normalise(text: Column) -> Column:
    """Canonical form; line ends are kept so that blocks and lines can be cut from it."""
    t = F.lower(or_empty(text))
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$", "")
    for old, new in EQUIVALENT:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f ©‐-―‘-‟•…]+", " ")


def _flat(unit: Column) -> Column:
    return F.btrim(F.regexp_replace(unit, r"[ \n]+", " "))


def _units(norm: Column) -> Column:
    """(scope, digest) of every non-blank unit of a normalised text."""
    def unit(scope, c):
        return F.struct(F.lit(scope).alias("scope"), F.md5(c).alias("digest"), (c == "").alias("blank"))

    lines = F.transform(F.split(norm, "\n"), lambda l: unit("line", F.btrim(l)))
    blocks = F.transform(F.split(norm, r"\n(?: *\n)+"), lambda b: unit("block", _flat(b)))
    return F.concat(F.array(unit("document", _flat(norm))), blocks, lines)


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, scope, license, n)``: how many units of a scope of the document equal a known licence."""
    names = known.select("license", F.md5(_flat(normalise(F.col("text")))).alias("digest"), _flat(normalise(F.col("text"))).alias("u")) \
        .filter("u != ''").select("license", "digest").distinct()
    units = docs.select(F.col(key).alias("key_"), F.inline_outer(bind(normalise(F.col(text)), _units))) \
        .filter("NOT blank").select("key_", "scope", "digest")
    return units.join(names, "digest").groupBy("key_", "scope", "license").agg(F.count("*").alias("n")) \
        .select(F.col("key_").alias(key), "scope", "license", "n")
