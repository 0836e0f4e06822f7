"""Whole license texts and notices with template markup (operator 9).

``[[ ... ]]`` may be left out, ``{{lo..hi}}`` stands for that many words of the licensor's choice.
Labels are the public identifiers of the licenses with ``-text`` for the whole wording and
``-notice`` for the statement that a file carries.  Copyright lines are not part of a template.
"""

from __future__ import annotations

# Wording as published with each license.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"""
_DEALINGS = """TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_NO_CLAIM = f"""{_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL {{{{2..8}}}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, {_DEALINGS}"""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so"""
_MIT_CONDITION = """subject to the following conditions: The above copyright notice and this permission notice
[[ (including the next paragraph) ]] shall be included in all copies or substantial portions of the Software."""

_ISC_GRANT = """Permission to use, copy, modify, [[ and ]] [[ or ]] distribute this software for any purpose with or without
fee is hereby granted"""
_ISC_CONDITION = "provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND {{1..8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{1..8}} BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted
[[ (subject to the limitations in the disclaimer below) ]] provided that the following conditions are met:
[[ 1. ]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. [[ 2. ]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """[[ 3. ]] Neither the name of {{1..12}} nor the names of [[ its ]] [[ any ]] contributors may be used to
endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY {{1..12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
{{1..12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(kind: str, version: str, what: str = "program") -> str:
    """The notice of a GNU license; ``what`` is the word for the licensed work."""
    name = f"GNU {kind} License"
    return f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the
{name} along with this {what}"""


WHOLE_TEXTS = {
    "mit-text": f"{_MIT_GRANT}, {_MIT_CONDITION} {_NO_CLAIM}",
    "mit-0-text": f"{_MIT_GRANT}. {_NO_CLAIM}",
    "isc-text": f"{_ISC_GRANT}, {_ISC_CONDITION} {_ISC_DISCLAIMER}",
    "0bsd-text": f"{_ISC_GRANT}. {_ISC_DISCLAIMER}",
    "bsd-2-clause-text": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will {{1..8}} be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: [[ 1. ]] The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an {{1..1}} in the product documentation would be appreciated but is not
required. [[ 2. ]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. [[ 3. ]] This notice may not be removed or altered from any source distribution.""",
    "bsl-1.0-text": f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in
the form of machine-executable object code generated by a source language processor. {_AS_IS}, TITLE AND NON-INFRINGEMENT. IN
NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER
IN CONTRACT, {_DEALINGS}""",
    "unlicense-text": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act
of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_NO_CLAIM}""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at {{0..8}} Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at""",
    "cc0-1.0-notice": """To the extent possible under law, {{1..20}} has waived all copyright and related or neighboring rights
to""",
    "gpl-2.0-or-later-notice": _gnu("General Public", "2"),
    "gpl-3.0-or-later-notice": _gnu("General Public", "3"),
    "lgpl-2.1-or-later-notice": _gnu("Lesser General Public", "2.1", "library"),
    "lgpl-3.0-or-later-notice": _gnu("Lesser General Public", "3", "{{1..1}}"),
    "agpl-3.0-or-later-notice": _gnu("Affero General Public", "3"),
}
