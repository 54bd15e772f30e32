"""More known licences: entire texts (files beside this one, and short ones here) and wordings of notices."""

from __future__ import annotations

from pathlib import Path

_AS_IS = "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Copyright (c) <year> <holder>\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "\n\n{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Short texts without their titles.
SHORT = {
    "BSD-2-Clause": [_BSD + _AS_IS],
    "BSD-3-Clause": [_BSD + _THIRD + _AS_IS],
    "0BSD": ["Copyright (c) <year> <holder>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE." + m for m in ("", "\n\nFor more information, please refer to <https://unlicense.org>", "\n\nFor more information, please refer to <https://unlicense.org/>")],
}
#: Titles that a text may stand under.
TITLES = {"MIT": ["The MIT License (MIT)", "The MIT License", "MIT License (MIT)"], "ISC": ["The ISC License"], "Zlib": ["The zlib License"], "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "Unlicense": ["The Unlicense"]}
#: What notices call a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0"], "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
_START = ["", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ", "This code is "]
_VERBS = ["licensed under", "released under", "distributed under", "made available under"]


def more_texts(known: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """(id, kind, text) of entire texts and notices beyond ``known``, whose texts get variants of their titles."""
    texts = {i: [t.partition("\n\n")[2]] for i, k, t in known if k == "text" and i in TITLES}
    numbered = [("1. ", "2. ", "3. "), ("", "", "")]  # marks such as * and - vanish in the canonical form
    texts |= {i: [t.format(*n) for t in ts for n in numbered] if i.startswith("BSD") else ts for i, ts in SHORT.items()}
    out = [(i, "text", f"{title}\n\n{t}".strip()) for i, ts in texts.items() for t in ts for title in ["", *TITLES[i]]]
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text("utf-8", "replace")
        out.append((path.stem, "text", text))
        if path.stem == "Apache-2.0":  # without the appendix
            out.append((path.stem, "text", text.partition("APPENDIX: How to apply")[0]))
        if "How to Apply These Terms" in text:
            cut = text.rfind("END OF TERMS AND CONDITIONS")
            out.append((path.stem, "text", text[: cut + 27] if cut > 0 else text))
    out += [(i, "notice", f"{s}{v} {the}{n}.") for i, names in NAMES.items() for n in names for s in _START for v in _VERBS for the in ("the ", "")]
    return out
