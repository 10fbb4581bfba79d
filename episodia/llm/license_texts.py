"""Known licence texts and one-line notices (fixed values: the public texts of the licences).

``licenses`` beside this file has further whole texts, one file a licence.
"""

from pathlib import Path

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Licence name, text. A text is a whole licence or a notice that stands alone on a line.
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + ISC_TAIL),
    ("0BSD", ISC_GRANT + ".\n" + ISC_TAIL),
    ("BSD-2-Clause", "\n".join([BSD_HEAD, BSD_1, BSD_2, BSD_TAIL])),
    ("BSD-3-Clause", "\n".join([BSD_HEAD, BSD_1, BSD_2, BSD_3, BSD_TAIL])),
    ("Zlib", ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]

#: Licence name, other names in notices, SPDX identifiers.
NAMES = [
    ("MIT", ["MIT License", "MIT"], ["MIT"]),
    ("ISC", ["ISC License"], ["ISC"]),
    ("0BSD", ["Zero-Clause BSD License", "BSD Zero Clause License"], ["0BSD"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"], ["BSD-2-Clause"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "Modified BSD License"], ["BSD-3-Clause"]),
    ("Zlib", ["zlib License"], ["Zlib"]),
    ("Unlicense", ["Unlicense"], ["Unlicense"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0"], ["BSL-1.0"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"], ["Apache-2.0"]),
    ("Artistic-1.0", ["Artistic License 1.0"], ["Artistic-1.0", "Artistic-1.0-Perl"]),
    ("Artistic-2.0", ["Artistic License 2.0"], ["Artistic-2.0"]),
    ("EPL-2.0", ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"], ["EPL-2.0"]),
    ("CC0-1.0", ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal"], ["CC0-1.0"]),
]
for _n, _title in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License"), ("GFDL", "GNU Free Documentation License"), ("MPL", "Mozilla Public License")):
    for _v in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",), "GFDL": ("1.1", "1.2", "1.3"), "MPL": ("1.1", "2.0")}[_n]:
        _own = [_v, _v.removesuffix(".0")]
        NAMES.append((f"{_n}-{_v}", [x for v in _own for x in (f"{_title}, version {v}", f"{_title} v{v}", f"{_title} {v}", f"{_n} {v}", f"{_n}v{v}")], [f"{_n}-{_v}", f"{_n}-{_v}-only", f"{_n}-{_v}-or-later"]))
for _kind, _title in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _where in (("3.0", "Unported"), ("4.0", "International")):
        NAMES.append((f"CC-{_kind}-{_v}", [f"CC {_kind} {_v}", f"Creative Commons {_title} {_v}", f"Creative Commons {_title} {_v} {_where} License", f"Creative Commons {_title} {_v} License"], [f"CC-{_kind}-{_v}"]))

NOTICES = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "Released under {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This work is licensed under {}", "This project is licensed under the {}", "This software is licensed under the {}", "This project is licensed under the terms of the {}", "This software is released under the {}", "License: {}"]


def further() -> list[tuple[str, str]]:
    """Whole texts of the data files (also without what follows the terms), short notices and SPDX lines."""
    out = []
    for file in sorted((Path(__file__).resolve().parent / "licenses").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms = text.partition("END OF TERMS AND CONDITIONS")
        out.append((file.stem, text))
        if terms[1]:
            out += [(file.stem, terms[0]), (file.stem, terms[0] + terms[1])]
    for name, titles, ids in NAMES:
        out += [(name, notice.format(title)) for title in titles for notice in NOTICES]
        out += [(name, f"SPDX-License-Identifier: {x}") for x in ids]
    out.append(("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'))
    return out
