"""The texts that the license scan looks for."""

from __future__ import annotations

import re

# What short notices call a license, by SPDX identifier.
NAMES = (
    ("0BSD", "Zero-Clause BSD License", "0BSD License"),
    ("AFL-3.0", "Academic Free License version 3.0"),
    ("AGPL-3.0-only", "GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPL version 3", "AGPL-3.0", "AGPLv3"),
    ("AGPL-3.0-or-later", "GNU Affero General Public License version 3 or later", "GNU AGPL version 3 or later", "AGPL-3.0-or-later"),
    ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    ("Artistic-2.0", "Artistic License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "Boost Software License 1.0"),
    ("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    ("CDDL-1.0", "Common Development and Distribution License 1.0"),
    ("EPL-1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    ("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    ("EUPL-1.2", "European Union Public Licence 1.2", "EUPL 1.2"),
    ("GFDL-1.3-or-later", "GNU Free Documentation License, Version 1.3 or any later version"),
    ("GPL-2.0-only", "GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPL-2.0", "GPLv2", "GPL v2"),
    ("GPL-2.0-or-later", "GNU General Public License version 2 or later", "GNU GPL version 2 or later", "GPL-2.0-or-later", "GPLv2 or later"),
    ("GPL-3.0-only", "GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPL-3.0", "GPLv3", "GPL v3"),
    ("GPL-3.0-or-later", "GNU General Public License version 3 or later", "GNU GPL version 3 or later", "GPL-3.0-or-later", "GPLv3 or later"),
    ("ISC", "ISC License"),
    ("LGPL-2.1-only", "GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "LGPL-2.1", "LGPLv2.1"),
    ("LGPL-2.1-or-later", "GNU Lesser General Public License version 2.1 or later", "GNU LGPL version 2.1 or later", "LGPL-2.1-or-later"),
    ("LGPL-3.0-only", "GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "LGPL-3.0", "LGPLv3"),
    ("LGPL-3.0-or-later", "GNU Lesser General Public License version 3 or later", "GNU LGPL version 3 or later", "LGPL-3.0-or-later"),
    ("MIT", "MIT License", "MIT Licence", "Expat License"),
    ("MIT-0", "MIT No Attribution License", "MIT-0 License"),
    ("MPL-1.1", "Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"),
    ("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    ("ODbL-1.0", "Open Database License 1.0", "Open Data Commons Open Database License v1.0"),
    ("OFL-1.1", "SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    ("PostgreSQL", "PostgreSQL License"),
    ("Unlicense", "Unlicense"),
    ("WTFPL", "WTFPL", "Do What The Fuck You Want To Public License"),
    ("Zlib", "zlib License"),
)

# The parts of Creative Commons licenses, short and in words, and the versions that are told apart.
COMMONS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
COMMONS_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))

# The GNU licenses' names, short and long, with the versions that are told apart.
GNU = (
    ("GPL", "General Public License", ("2.0", "3.0")),
    ("LGPL", "Lesser General Public License", ("2.1", "3.0")),
    ("AGPL", "Affero General Public License", ("3.0",)),
)

# Licenses that are called by one word, and the words that lead such a one.
SINGLE = (("MIT", "MIT"), ("ISC", "ISC"), ("Zlib", "zlib"), ("Unlicense", "Unlicense"), ("WTFPL", "WTFPL"), ("0BSD", "0BSD"), ("GPL-2.0-only", "GPLv2"), ("GPL-3.0-only", "GPLv3"), ("LGPL-3.0-only", "LGPLv3"), ("AGPL-3.0-only", "AGPLv3"))
SINGLE_LEADS = ("License:", "License ::", "Licence:", "Available under", "Available under the", "Under the terms of the", "Under the terms of", "Licensed under", "Licensed under the", "Dual licensed under", "Dual licensed under the")

# The words that lead a short notice.
LEADS = ("Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under", "Distributed under the", "This work is licensed under the", "This work is licensed under a")

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_END = f"""{_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu(name: str, version: str, later: bool) -> str:
    """The notice that the GNU licenses ask for at the head of a file."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which}."


# Whole licenses, and the notices that longer ones ask for.
TEXTS = (
    ("0BSD", f"{_ISC_GRANT}. {_ISC_END}"),
    ("AGPL-3.0-only", _gnu("Affero General Public License", "3", False)),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", "3", True)),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} {_BSD_THIRD} {_BSD_END}"),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0-only", _gnu("General Public License", "2", False)),
    ("GPL-2.0-or-later", _gnu("General Public License", "2", True)),
    ("GPL-3.0-only", _gnu("General Public License", "3", False)),
    ("GPL-3.0-or-later", _gnu("General Public License", "3", True)),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("LGPL-2.1-only", _gnu("Lesser General Public License", "2.1", False)),
    ("LGPL-2.1-or-later", _gnu("Lesser General Public License", "2.1", True)),
    ("LGPL-3.0-only", _gnu("Lesser General Public License", "3", False)),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "3", True)),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_END}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-0", f"{_MIT_GRANT}. {_MIT_END}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""),
)


def _commons() -> list[tuple[str, str]]:
    out = []
    for short, words in COMMONS:
        for version, scope in COMMONS_VERSIONS:
            names = (f"CC {short} {version}", f"Creative Commons {words} {version} License", f"Creative Commons {words} {version} {scope} License")
            out += [(f"CC-{short}-{version}", n) for n in names]
    return out


def _gnu_names() -> list[tuple[str, str]]:
    out = []
    for short, words, versions in GNU:
        for version in versions:
            spellings = (version, version.removesuffix(".0")) if version.endswith(".0") else (version,)
            for name in (short, words):
                out += [(f"{short}-{version}-only", form.format(n=name, v=v)) for v in spellings for form in ("{n} version {v}", "{n} v{v}", "{n} {v}", "version {v} of the GNU {n}")]
    return out


def named() -> tuple[tuple[str, str], ...]:
    """(SPDX identifier, name) of two words or more: what a license is called after words that lead to it."""
    made = [*((spdx, n) for spdx, *own in NAMES for n in own), *_commons(), *_gnu_names()]
    made += [(spdx, spdx) for spdx in dict.fromkeys(s for s, _ in made)]
    first: dict[tuple[str, ...], tuple[str, str]] = {}
    for spdx, name in made:
        words = tuple(re.findall("[0-9a-z]+", name.lower()))
        if len(words) > 1:
            first.setdefault(words, (spdx, name))
    return tuple(first.values())


def templates() -> tuple[tuple[str, str], ...]:
    """(SPDX identifier, text): whole licenses and file notices, every lead with every name, and SPDX tags; no text twice."""
    names = [(spdx, n) for spdx, *own in NAMES for n in own] + _commons()
    made = [*TEXTS, *((spdx, f"{lead} {n}.") for spdx, n in names for lead in LEADS)]
    made += [(spdx, f"{lead} {n}") for spdx, n in SINGLE for lead in SINGLE_LEADS]
    made += [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in dict.fromkeys(s for s, _ in made)]
    return tuple({text: (spdx, text) for spdx, text in made}.values())


TEMPLATES = templates()
NAMED = named()
#: Members of an expression, by lower-cased identifier; GNU identifiers without "only" are that version alone.
IDENTIFIERS = {n.lower(): spdx for spdx, n in SINGLE} | {s.lower(): s for s, _ in TEMPLATES} | {s.removesuffix("-only").lower(): s for s, _ in TEMPLATES if s.endswith("-only")}
