"""Licence scans by canonical digests, with SQL functions only.

A text is brought to a canonical form: ASCII letters in lower case, lines that
begin with a copyright notice left out, equivalent spellings made one, every
run of other ASCII signs one space, so that case, punctuation and line breaks
count for nothing.  The digest of the whole form is looked up in a table of known
licences by a hash join.  So is that of each line that speaks of a licence or of
rights: a line may be a declaration as a whole (there a notice is not left out).

The known tables are fixed lists in this file, of a few dozen rows whatever the
input, so they are broadcast: digests of whole licence texts, some texts in full,
and lines.  Further ones may be given as a table, which Spark joins as its size asks.

Null texts count as empty and match nothing; repeated rows each have a row; null
doc_ids stay; very long texts are read in full; of licences with the same digest the
last name by order is told; an empty table gives an empty table; extra columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import renamed

#: Spellings held for the same (fixed values; after lower case, before signs go).
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("favour", "favor"), ("authorisation", "authorization"), ("recognised", "recognized"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("https://", "http://"), ("&", " and "), ("“", '"'), ("”", '"'), ("’", "'"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that begin with a notice, and signs that part words: patterns alike in Java and in RE2.
NOTICE, SIGNS = r"(^|\n)[ \t*#/;-]*(copyright[ \t:]*(\(c\)|©|[0-9<\[{]|by )|(\(c\)|©)[ \t]*[0-9<\[{]|all rights reserved)[^\n]*", r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Every known line has one of these, in whatever case.
SPEAKS = ("licen", "reserved")

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = f"{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Known licences as whole texts, and declarations as whole lines (fixed values).
TEXTS = (
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("MIT-0", f"{_PERMISSION}.\n\n{_AS_IS}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("ISC", f"ISC License\n\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}"),
    ("0BSD", f"{_ISC}.\n\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD}{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD}{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}{_BSD_3}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD}{_BSD_3}{_BSD_END}"),
)
#: Canonical digests of whole texts as their authors publish them, with and without appendix, postal address or title (fixed values).
DIGESTS = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "07a71a982fcb1d067ca668d48b7cea8eb8416e38e358b9ab96b3056f93457e6a"),
    ("Apache-2.0", "7b43ee8f1e8c954af35f9a316ad24ee0e263b15c3511a472b7f547619129345e"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Apache-2.0", "95fe918080644b73e2cc66e44365b39771ff03145db9764a775f521afece4bba"),
    ("Apache-2.0", "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7"),
    ("Apache-2.0 WITH LLVM-exception", "6162751997524abc581d0e7fd1b10f334ec61e6d7e34d4014bace4371153dbe0"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CDLA-Permissive-2.0", "6ee3488bcad340dc63d0c7ce8143c10429cf2bbc5c4cac9ba6da003d5a3853c0"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("PSF-2.0", "8295946602d6bebee344262714363fd035c5c857480438c14f2d11126b59034f"),
    ("Unicode-3.0", "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),
)
LINES = (
    ("All rights reserved", "All rights reserved."),
    ("All rights reserved", "All rights reserved"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical(text: Column, notices: bool = False) -> Column:
    """The canonical form; notices: lines that begin with one are kept."""
    found = F.translate(text, UPPER, LOWER)
    if not notices:
        found = F.regexp_replace(found, NOTICE, "\n")
    for a, b in SPELLINGS:
        found = F.replace(found, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(found, SIGNS, " "))


def digest(text: Column, notices: bool = False) -> Column:
    return F.sha2(canonical(text, notices), 256)


def known(spark) -> DataFrame:
    """(kind, digest, license) of the fixed lists; kind: text or line."""
    listed = lambda kind, some: F.transform(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in some]), lambda x: F.struct(F.lit(kind).alias("kind"), digest(x["text"], kind == "line").alias("digest"), x["license"].alias("license")))
    told = F.array(*[F.struct(F.lit("text").alias("kind"), F.lit(d).alias("digest"), F.lit(n).alias("license")) for n, d in DIGESTS])
    return spark.range(1).select(F.inline(F.concat(listed("text", TEXTS), listed("line", LINES), told))).distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, declared): the licence that the whole text is, and those that its lines declare, each null if none.

    more: further (kind, digest, license) rows; lines are found by those only if they say one of ``SPEAKS``.
    """
    source = renamed(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def speaks(x: Column) -> Column:
        low = F.translate(x, UPPER, LOWER)
        return F.contains(low, F.lit(SPEAKS[0])) | F.contains(low, F.lit(SPEAKS[1]))

    lines = F.filter(F.split("text", "\n", -1), speaks)
    whole = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", digest(F.col("text")).alias("canonical_sha256"), F.transform(lines, lambda x: digest(x, True)).alias("lines"))
    asked = F.concat(F.array(F.struct(F.lit("text").alias("kind"), F.col("canonical_sha256").alias("digest"))), F.transform("lines", lambda x: F.struct(F.lit("line").alias("kind"), x.alias("digest"))))
    looked = whole.select("row", "doc_id", "canonical_sha256", F.explode(asked).alias("asked")).select("row", "doc_id", "canonical_sha256", "asked.kind", "asked.digest")
    table = F.broadcast(known(docs.sparkSession)) if more is None else known(docs.sparkSession).unionByName(more.select("kind", "digest", "license")).distinct()
    found = looked.join(table, ["kind", "digest"], "left")
    joined = F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == "line", F.col("license")))), ",")
    return found.groupBy("row", "doc_id", "canonical_sha256").agg(F.max(F.when(F.col("kind") == "text", F.col("license"))).alias("license_id"), F.nullif(joined, F.lit("")).alias("declared")).drop("row")
