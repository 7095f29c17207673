"""License scan: Dice coefficient over word bigrams against licence templates.

Units are the lines of a text, its paragraphs (runs of non-blank lines), runs
of consecutive paragraphs, the whole text, and all windows of as many words as
the template has. A unit of a bigrams, c of them in a template of b bigrams, can
only reach Dice d if d/(2-d) * b <= a <= (2-d)/d * b, and then c >= d/(2-d) * b.
So a text that has fewer of a template's bigrams in all needs no units of it.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, OrderedDict, deque
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

#: Licence notices and short licence texts, as their owners publish them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "This project is licensed under the terms of the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-notice": "Licensed under CC BY 4.0.",
    "MIT-notice-3": "Licensed under the MIT License.",
    "MIT-notice-4": "This project is licensed under the MIT License.",
    "MIT-notice-5": "Distributed under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-notice": "This work is licensed under the GNU Lesser General Public License.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC-BY-NC-SA-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

TEMPLATES |= {f"{x}-SPDX": f"SPDX-License-Identifier: {x}" for x in ("MIT", "ISC", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0")}
#: Full texts, a file each.
TEMPLATES |= {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(text: str) -> set[tuple[str, str]]:
    own = words(text)
    return set(zip(own, own[1:]))


def bounds(size: int, threshold: float) -> tuple[float, float]:
    return threshold / (2 - threshold) * size, (2 - threshold) / threshold * size


def paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"\n\s*\n", text) if p.strip()]


def runs(parts: list[list[str]], holders: dict[tuple[str, str], list[str]], most: float):
    """Number of bigrams, and of those shared with each template, of each run of two or more consecutive parts, up to ``most``.

    ``holders`` has the templates of a bigram. Runs that begin or end with a part
    without any of these are no better than shorter ones, nor are those whose
    last part adds no bigram. Starts are taken from the last part back, and
    bigrams kept in order of the part they come next in; so a start looks at no
    more than ``most`` distinct bigrams, however often parts repeat.
    """
    place: OrderedDict[tuple[str, str], int] = OrderedDict()  # the nearest last

    def put(gram: tuple[str, str], at: int) -> None:
        place[gram] = at
        place.move_to_end(gram)

    for i in range(len(parts) - 1, -1, -1):
        first = parts[i]
        if i + 1 < len(parts):
            put((first[-1], parts[i + 1][0]), i + 1)
        begins = i + 1 < len(parts) and (first[-1], parts[i + 1][0]) in holders
        for gram in zip(first, first[1:]):
            put(gram, i)
            begins = begins or gram in holders
        if not begins:
            continue
        size, at = 0, i
        common: Counter = Counter()
        shared: list[str] = []
        for gram in reversed(place):
            if place[gram] != at:  # a part is whole
                common.update(shared)
                if shared and at > i:
                    yield size, common
                at, shared = place[gram], []
            size += 1
            if size > most:
                break
            shared += holders.get(gram, ())
        else:
            common.update(shared)
            if shared and at > i:
                yield size, common


def best_window(own: list[tuple[str, str]], template: set[tuple[str, str]], size: int) -> float:
    """The largest Dice of ``size`` consecutive bigrams; counts are updated as the window moves."""
    held: Counter = Counter()
    window: deque = deque()
    common, best = 0, 0.0
    for gram in own:
        window.append(gram)
        held[gram] += 1
        if held[gram] == 1 and gram in template:
            common += 1
        if len(window) > size:
            old = window.popleft()
            held[old] -= 1
            if not held[old]:
                del held[old]
                common -= old in template
        if len(window) == size:
            best = max(best, 2 * common / (len(held) + len(template)))
    return best


def scanner(templates: dict[str, str], threshold: float):
    """A function from a text to its matches: (template, dice), best first; ties by name."""
    sets = {k: bigrams(v) for k, v in templates.items()}
    lengths = {k: len(words(v)) - 1 for k, v in templates.items()}
    sizes = {k: bounds(len(v), threshold) for k, v in sets.items()}
    known = frozenset().union(*sets.values())
    least = min(x for x, _ in sizes.values()) - 1e-9

    def scan(text: str) -> list[tuple[str, float]]:
        own = words(text)
        own = list(zip(own, own[1:]))
        hits = known.intersection(own)
        if len(hits) < least:
            return []
        asked = {k: v for k, v in sets.items() if len(hits & v) >= sizes[k][0] - 1e-9}
        if not asked:
            return []
        best: dict[str, float] = {}

        def compare(unit: set) -> None:
            for name, template in asked.items():
                if sizes[name][0] - 1e-9 <= len(unit) <= sizes[name][1] + 1e-9:
                    dice = 2 * len(unit & template) / (len(unit) + len(template))
                    if dice >= threshold and dice > best.get(name, 0):
                        best[name] = dice

        for line in text.split("\n"):
            compare(bigrams(line))
        compare(set(own))
        parts = [own_words for p in paragraphs(text) if (own_words := words(p))]
        for part in parts:
            compare(set(zip(part, part[1:])))
        holders: dict[tuple[str, str], list[str]] = {}
        for name, template in asked.items():
            for gram in hits & template:
                holders.setdefault(gram, []).append(name)
        for size, common in runs(parts, holders, max(sizes[k][1] for k in asked)):
            for name, c in common.items():
                dice = 2 * c / (size + len(sets[name]))
                if dice >= threshold and dice > best.get(name, 0):
                    best[name] = dice
        for name, template in asked.items():
            dice = best_window(own, template, lengths[name])
            if dice >= threshold and dice > best.get(name, 0):
                best[name] = dice
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))

    return scan


@functools.lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...] | None, threshold: float):
    """Built once a Python worker; None stands for TEMPLATES."""
    return scanner(TEMPLATES if templates is None else dict(templates), threshold)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, matches = array of (template, dice), best first.

    Null and empty texts match nothing. Ties go by the template's name. Repeated
    rows are scanned each for itself. A text of any length is scanned whole, its
    windows in steps of a word and its runs of paragraphs from each that has a
    bigram of a template, over at most as many bigrams as a match may have. An empty table gives an empty result; other columns are ignored.
    ``templates`` ride along with the tasks: they are a fixed list of texts, not data.
    """
    asked = tuple(templates.items()) if templates else None
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("template", pa.string()), ("dice", pa.float64())]))

    def run(batch: pa.RecordBatch) -> dict:
        scan = _scanner(asked, threshold)
        found = [[{"template": t, "dice": d} for t, d in scan(x)] for x in texts(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "matches": pa.array(found, kind)}

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {id_type}, matches array<struct<template:string,dice:double>>")


def digest(scanned: DataFrame) -> DataFrame:
    first = F.get("matches", F.lit(0))
    return scanned.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        first["template"].alias("license"),
        F.coalesce(first["dice"], F.lit(0.0)).alias("dice"),
        F.array_join(F.transform("matches", lambda x: x["template"]), ",").alias("licenses"),
    )
