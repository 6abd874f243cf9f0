"""Templates of public licences for the scan: whole texts, and notices of all.

Braces mark the words that tell a licence from its relatives: a match must have each of them, and between the first and the
last no other word that is in braces anywhere here. The whole texts of long licences (GNU, Apache, Mozilla, Artistic, CC0,
CC-BY-SA, OFL) are the files of ``license_bodies``, named by their identifiers, as published; the driver reads them, and the
Affero licence is made of the general one by rule. Bodies of others can be passed in ``templates``.
"""

from __future__ import annotations

import re
from pathlib import Path

BODIES = Path(__file__).parent / "license_bodies"

#: Public licence texts and notices, without titles and copyright lines.
PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEXTS = {
    "MIT-text": f"{PERMISSION}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}",
    "MIT-0-text": f"{PERMISSION}. {AS_IS}",
    "BSD-2-Clause": f"{BSD_GRANT} {BSD_AS_IS}",
    "BSD-3-Clause": f"{BSD_GRANT} {BSD_NAMES} {BSD_AS_IS}",
    "ISC-text": f"{ISC_GRANT}, {ISC_NOTICE} {ISC_AS_IS}",
    "0BSD-text": f"{ISC_GRANT}. {ISC_AS_IS}",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Apache-2.0-header": "Licensed under the Apache License, Version {2.0} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version {1.1} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License {v1.0}",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License {2.0}",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License, Version {1.0}",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0-short": "Licensed under {CC0} {1.0} Universal.",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
}
#: How texts name a licence in a line.
LINES = {
    "Apache-2.0": "Licensed under the Apache License, Version {2.0}.",
    "Apache-1.1": "Licensed under the Apache License, Version {1.1}.",
    "MIT": "Released under the {MIT} License.",
    "ISC": "Released under the {ISC} License.",
    "BSD-2-Clause-line": "Released under the {BSD} {2}-Clause License.",
    "BSD-3-Clause-line": "Released under the {BSD} {3}-Clause License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version {2.0}.",
}
#: Name, words and versions of the GNU family, and of the Creative Commons kinds.
GNU = {"GPL": ("{GNU} {General}", ("2", "3")), "LGPL": ("{GNU} {Lesser} {General}", ("2.1", "3")), "AGPL": ("{GNU} {Affero} {General}", ("3",))}
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-{ShareAlike}", "BY-NC": "Attribution-{NonCommercial}", "BY-NC-SA": "Attribution-{NonCommercial}-{ShareAlike}", "BY-ND": "Attribution-{NoDerivatives}", "BY-NC-ND": "Attribution-{NonCommercial}-{NoDerivatives}"}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


#: Identifiers as files state them, with the words that tell them apart in braces.
STATED = {
    "MIT": "{MIT}", "ISC": "{ISC}", "Zlib": "{Zlib}", "Unlicense": "{Unlicense}", "WTFPL": "{WTFPL}", "0BSD": "{0BSD}", "BSL-1.0": "{BSL}-{1.0}", "CC0-1.0": "{CC0}-{1.0}", "Apache-2.0": "{Apache}-{2.0}", "BSD-2-Clause": "{BSD}-{2}-Clause",
    "BSD-3-Clause": "{BSD}-{3}-Clause", "MPL-1.1": "{MPL}-{1.1}", "MPL-2.0": "{MPL}-{2.0}", "EPL-1.0": "{EPL}-{1.0}", "EPL-2.0": "{EPL}-{2.0}", "CDDL-1.0": "{CDDL}-{1.0}", "OFL-1.1": "{OFL}-{1.1}", "Artistic-2.0": "{Artistic}-{2.0}",
}
STATED |= {f"{k}-{v}": f"{{{k}}}-{{{v}}}" for k, vs in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("1.0", "3.0")), ("GFDL", ("1.1", "1.2", "1.3"))) for v in vs}
COUNTED = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-1.0", "AGPL-3.0", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3")
#: Further lines that name a licence; {n} stands for a short name of the GNU family, {v} for its version.
FORMS = {"MIT-line": "is {MIT} licensed", "MIT-terms": "under the terms of the {MIT} license", "Apache-2.0-terms": "under the terms of the Apache License, Version {2.0}", "Apache-2.0-and": "and Apache License, Version {2.0}"}
#: Words of a licence's own name that make it another licence where they are put in.
NAMING = ("Affero", "Lesser", "Library", "NonCommercial", "NoDerivatives", "ShareAlike")
#: What the Affero licence of version 3 has in the place of parts of the general one, as published.
AFFERO_OPENING = (
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software. "
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, our General Public Licenses are intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. "
)
AFFERO_MIDDLE = (
    "Developers that use our General Public Licenses protect your rights with two steps: (1) assert copyright on the software, and (2) offer you this License which gives you legal permission to copy, distribute and/or modify the software. "
    "A secondary benefit of defending all users' freedom is that improvements made in alternate versions of the program, if they receive widespread use, become available for other developers to incorporate. Many developers of free software are heartened and encouraged by the resulting cooperation. "
    "However, in the case of software used on network servers, this result may fail to come about. The GNU General Public License permits making a modified version and letting the public access it on a server without ever releasing its source code to the public. "
    "The GNU Affero General Public License is designed specifically to ensure that, in such cases, the modified source code becomes available to the community. It requires the operator of a network server to provide the source code of the modified version running there to the users of that server. Therefore, public use of a modified version, on a publicly accessible server, gives the public access to the source code of the modified version. "
    "An older license, called the Affero General Public License and published by Affero, was designed to accomplish similar goals. This is a different license, not a version of the Affero GPL, but Affero has released a new version of the Affero GPL which permits relicensing under this license. "
)
AFFERO_13 = (
    "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. "
    "This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. "
    "The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License. "
)


def affero(general: str) -> str:
    """The Affero licence of version 3, made of the text of the general one: its name, preamble and section 13 differ."""
    text = " ".join(general.split())
    places = [text.index(x) for x in ("The GNU General Public License is a free", "When we speak of free software", "To protect your rights, we need", "The precise terms and conditions", "13. Use with the GNU Affero", "14. Revised Versions")]
    named = lambda t: t.replace("GNU General Public", "GNU Affero General Public").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    return named(text[: places[0]]) + AFFERO_OPENING + text[places[1] : places[2]] + AFFERO_MIDDLE + named(text[places[3] : places[4]]) + AFFERO_13 + named(text[places[5] :])


def bodies(folder: Path = BODIES) -> dict[str, str]:
    """name -> whole text of each file of a folder, and of the Affero licence; their own braces mark nothing."""
    found = {p.stem: p.read_text("utf-8") for p in sorted(folder.glob("*.txt"))}
    if "GPL-3.0" in found:
        found["AGPL-3.0"] = affero(found["GPL-3.0"])
    return {f"{name}-body": found[name].translate({ord("{"): " ", ord("}"): " "}) for name in sorted(found)}


def identifier(name: str) -> str:
    """The licence that a template's name stands for."""
    return re.sub(r"-(?:text|body|line|short|header|notice|stated|named|terms|and|v)$", "", name)


def templates() -> dict[str, str]:
    """name -> template, braces included."""
    out = {**TEXTS, **LINES, **FORMS, **bodies()}
    for name, stated in STATED.items():
        out[f"{name}-stated"] = f"SPDX-License-Identifier: {stated}"
        if "-" in name:  # a template has three words at least
            out[f"{name}-named"] = f"License: {stated}"
    for name in COUNTED:
        short, v = name.split("-")
        for rest in ("or-later", "only"):
            out[f"{name}-{rest}-stated"] = f"SPDX-License-Identifier: {{{short}}}-{{{v}}}-{rest}"
            out[f"{name}-{rest}-named"] = f"License: {{{short}}}-{{{v}}}-{rest}"
        v = v.removesuffix(".0")
        out[f"{name}-v"] = f"licensed under {{{short}v{v}}}" if "." not in v else f"licensed under {{{short}v{v.split('.')[0]}}}.{{{v.split('.')[1]}}}"
    for short, (words, versions) in GNU.items():
        for v in versions:
            name = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            out[f"{name}-line"] = f"under the {words} Public License, version {{{v}}}"
            out[name] = f"This work is licensed under the {words} Public License, version {{{v}}}."
            out[f"{name}-notice"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the {words} Public License as published by the Free Software Foundation, version {{{v}}} of the License."
            out[f"{name}-or-later"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the {words} Public License as published by the Free Software Foundation, either version {{{v}}} of the License, or (at your option) any later version."
    for short, words in COMMONS.items():
        for v in COMMONS_VERSIONS:
            kinds = "-".join(k if k == "BY" else f"{{{k}}}" for k in short.split("-"))
            out[f"CC-{short}-{v}"] = f"Licensed under {{CC}} {kinds} {{{v}}}."
            out[f"CC-{short}-{v}-line"] = f"This work is licensed under a Creative {{Commons}} {words} {{{v}}} International License."
    return out
