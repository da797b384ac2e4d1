"""The texts and notices that license scans look for, as (name, text) pairs."""

# Fixed: how licenses are named, and the versions that exist.
GNU = [
    ("GPL", "GNU General Public License", ["1", "2", "3"]),
    ("LGPL", "GNU Library General Public License", ["2"]),
    ("LGPL", "GNU Lesser General Public License", ["2.1", "3"]),
    ("AGPL", "GNU Affero General Public License", ["1", "3"]),
]
CREATIVE_COMMONS = [
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
CREATIVE_COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Fixed: terms by which licenses with alike notices differ.  A nought is none, as 2 and 2.0 are one version.
NAMING = """
    affero lesser library gpl lgpl agpl apache mit bsd isc mozilla mpl eclipse epl boost cc cc0
    nc nd sa noncommercial noderivatives noderivs derivatives sharealike commercial 1 2 3 4 5 6 7 8 9 v1 v2 v3
"""

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
MIT_REST = (
    ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_WARRANTY = (
    '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)

#: Fixed: whole texts of licenses that are short, and notices by which files state the others.
TEXTS = [
    ("0BSD-text", ISC_PERMISSION + ISC_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-2-Clause-text", BSD_CONDITIONS + BSD_TWO + BSD_WARRANTY),
    ("BSD-3-Clause-text", BSD_CONDITIONS + BSD_TWO + BSD_THIRD + BSD_WARRANTY),
    ("BSD-conditions", BSD_CONDITIONS),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at http://www.eclipse.org/legal/epl-2.0",
    ),
    ("ISC-text", ISC_PERMISSION + ISC_KEEP + ISC_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT-permission", MIT_PERMISSION),
    ("MIT-text", MIT_PERMISSION + MIT_REST + WARRANTY),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib-text",
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held '
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
]


def notices() -> list[tuple[str, str]]:
    """The notices of license families, one for each member, version and usual wording."""
    out = []
    for short, name, versions in GNU:
        for v in versions:
            spdx = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            out.append((spdx, f"Licensed under the {name}, version {v}."))
            out.append((spdx, f"This work is licensed under the {name}, version {v}."))
            free = "This program is free software: you can redistribute it and/or modify it under the terms of the"
            end = f"either version {v} of the License, or (at your option) any later version."
            out.append((f"{spdx}-header", f"{free} {name} as published by the Free Software Foundation, {end}"))
    for code, name in CREATIVE_COMMONS:
        for v in CREATIVE_COMMONS_VERSIONS:
            where = {"4.0": "International", "3.0": "Unported"}.get(v, "Generic")
            out.append((f"CC-{code}-{v}", f"Licensed under CC {code} {v}."))
            out.append((f"CC-{code}-{v}", f"Licensed under the Creative Commons {name} {v} {where} License"))
    return out


TEMPLATES = TEXTS + notices()
