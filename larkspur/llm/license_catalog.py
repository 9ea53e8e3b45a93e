"""Known license sentences, the licenses they belong to, and the ordered rules over their identifiers.

Sentences are normalised: lower case, every run of anything but a-z and 0-9 one space. What differs from one copy of a
text to the next (holders, the word for what is licensed, verbs of a reference) is put in one form first, by ``FORMS``.
References are made by rule from the licenses' names; sentences of texts and notices are listed.
"""

from __future__ import annotations

import re

#: license: (category, names by which references call it).
LICENSES: dict[str, tuple[str, tuple[str, ...]]] = {
    "MIT": ("permissive", ("mit license", "mit", "mit expat license", "expat license", "x11 mit license")),
    "MIT-0": ("permissive", ("mit no attribution license", "mit 0", "mit 0 license")),
    "Apache-1.1": ("permissive", ("apache software license version 1 1", "apache license 1 1", "apache 1 1 license")),
    "Apache-2.0": ("permissive", ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license version 2", "apache 2 license", "apache 2 0", "apache software license version 2 0", "apache license v2 0", "apache v2 license", "asl 2 0")),
    "BSD-2-Clause": ("permissive", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "two clause bsd license", "freebsd license", "bsd 2 clause simplified license")),
    "BSD-3-Clause": ("permissive", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "three clause bsd license", "revised bsd license", "bsd style license", "bsd license")),
    "BSD-4-Clause": ("permissive", ("bsd 4 clause license", "original bsd license", "4 clause bsd license")),
    "0BSD": ("permissive", ("bsd zero clause license", "0bsd license", "zero clause bsd license")),
    "ISC": ("permissive", ("isc license", "isc")),
    "EPL-1.0": ("copyleft", ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0")),
    "EPL-2.0": ("copyleft", ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0")),
    "MPL-1.1": ("copyleft", ("mozilla public license version 1 1", "mozilla public license 1 1", "mozilla public license v1 1", "mpl 1 1")),
    "MPL-2.0": ("copyleft", ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0", "mpl v2 0", "mpl version 2 0")),
    "CDDL-1.0": ("copyleft", ("common development and distribution license version 1 0", "common development and distribution license", "cddl 1 0", "cddl")),
    "EUPL-1.2": ("copyleft", ("european union public license version 1 2", "european union public license 1 2", "eupl version 1 2", "eupl 1 2", "eupl")),
    "CC0-1.0": ("permissive", ("cc0 1 0 universal", "cc0 1 0", "cc0", "creative commons zero", "creative commons cc0 1 0 universal license", "cc0 1 0 universal public domain dedication")),
    "Unlicense": ("permissive", ("unlicense",)),
    "WTFPL": ("permissive", ("wtfpl", "do what the fuck you want to public license")),
    "Zlib": ("permissive", ("zlib license", "zlib libpng license", "zlib")),
    "BSL-1.0": ("permissive", ("boost software license version 1 0", "boost software license 1 0", "boost software license")),
    "Artistic-1.0": ("permissive", ("artistic license 1 0", "artistic license version 1 0")),
    "Artistic-2.0": ("permissive", ("artistic license 2 0", "artistic license version 2 0", "artistic license")),
    "Python-2.0": ("permissive", ("python software foundation license version 2", "python software foundation license", "psf license", "psf license agreement")),
    "PostgreSQL": ("permissive", ("postgresql license",)),
    "OFL-1.1": ("permissive", ("sil open font license version 1 1", "sil open font license 1 1", "sil open font license", "ofl 1 1")),
    "NCSA": ("permissive", ("university of illinois ncsa open source license", "ncsa open source license", "university of illinois open source license")),
    "MS-PL": ("permissive", ("microsoft public license ms pl", "microsoft public license", "ms pl")),
    "ODbL-1.0": ("copyleft", ("open database license v1 0", "open database license odbl v1 0", "open data commons open database license", "open database license", "odbl")),
    "Beerware": ("permissive", ("beer ware license", "beerware license")),
    "GFDL-1.2": ("copyleft", ("gnu free documentation license version 1 2", "gfdl 1 2")),
    "GFDL-1.3": ("copyleft", ("gnu free documentation license version 1 3", "gnu free documentation license", "gfdl 1 3")),
    "BUSL-1.1": ("restricted", ("business source license 1 1", "business source license")),
    "SSPL-1.0": ("restricted", ("server side public license version 1", "server side public license")),
}
#: How a version number is said.
_VERSIONS = ("version {}", "version {} 0", "v{}", "v{} 0", "v {}", "{}", "{} 0")
#: license family: names, and versions.
_GNU = {
    "GPL": (("gnu general public license", "gnu gpl", "gpl", "general public license", "gnu general public license gpl"), ("1", "2", "3")),
    "LGPL": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl", "lesser general public license", "gnu lesser general public license lgpl"), ("2", "2 1", "3")),
    "AGPL": (("gnu affero general public license", "gnu agpl", "agpl", "affero general public license", "gnu affero general public license agpl"), ("3",)),
}
#: Creative Commons' parts: SPDX part, category, names.
_CC = {
    "BY": ("permissive", ("attribution",)), "BY-SA": ("copyleft", ("attribution sharealike", "attribution share alike")), "BY-ND": ("restricted", ("attribution noderivatives", "attribution noderivs", "attribution no derivatives")),
    "BY-NC": ("restricted", ("attribution noncommercial", "attribution non commercial")), "BY-NC-SA": ("restricted", ("attribution noncommercial sharealike", "attribution non commercial share alike")),
    "BY-NC-ND": ("restricted", ("attribution noncommercial noderivatives", "attribution noncommercial noderivs", "attribution non commercial no derivatives")),
}


#: Families named without a version, which say less than a license of theirs: (category, names).
_FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "GPL": ("copyleft", ("gpl", "gnu gpl", "gnu general public license", "general public license", "gnu general public license gpl")),
    "LGPL": ("copyleft", ("lgpl", "gnu lgpl", "gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lesser general public license lgpl")),
    "AGPL": ("copyleft", ("agpl", "gnu agpl", "gnu affero general public license", "affero general public license", "gnu affero general public license agpl")),
    "Apache": ("permissive", ("apache", "apache license", "apache software license")),
    "MPL": ("copyleft", ("mpl", "mozilla public license")),
    "EPL": ("copyleft", ("epl", "eclipse public license")),
    "BSD": ("permissive", ("bsd",)),
}


def _versioned(family: str, version: str) -> str:
    return f"{family}-{version.replace(' ', '.')}{'' if ' ' in version else '.0'}"


def licenses() -> dict[str, tuple[str, tuple[str, ...]]]:
    """LICENSES, the families that have versions, and what is named without one."""
    out = LICENSES | _FAMILIES
    for family, (names, versions) in _GNU.items():
        for v in versions:
            forms = [f.format(v) for f in (_VERSIONS if " " not in v else _VERSIONS[::2])]
            short = [f"{family.lower()}v{v}", f"{family.lower()}{v}"]
            out[_versioned(family, v)] = "copyleft", tuple([*(f"{a} {b}" for a in names for b in forms), *short])
    for part, (kind, names) in _CC.items():
        spoken = part.lower().replace("-", " ")
        for v in ("3 0", "4 0"):
            long = [f"creative commons {n} {v}{w}" for n in names for w in ("", " international", " unported", " international public")]
            out[f"CC-{part}-{v.replace(' ', '.')}"] = kind, tuple(f"{n}{w}" for n in [f"cc {spoken} {v}", f"creative commons {spoken} {v}", *long] for w in ("", " license"))
        out[f"CC-{part}"] = kind, tuple(f"{n}{w}" for n in [f"cc {spoken}", f"creative commons {spoken}", *(f"creative commons {n}" for n in names)] for w in ("", " license"))
    return {name: (kind, tuple(dict.fromkeys([*names, *_spoken(name)]))) for name, (kind, names) in out.items()}


def _spoken(name: str) -> list[str]:
    """A license's identifier as words, as it stands in fields."""
    said = name.lower().replace("-", " ").replace(".", " ")
    gnu, _, version = name.partition("-")
    return [f"{said}{more}" for more in ("", " only", " or later", " plus")] if gnu in _GNU and version else [said]


def shared(known: list[list[str]]) -> str:
    """A pattern of all these word sequences that tries longer ones first; common beginnings are written once."""
    by_word: dict[str, list[list[str]]] = {}
    for ws in known:
        if ws:
            by_word.setdefault(ws[0], []).append(ws[1:])
    parts = []
    for word, rests in by_word.items():
        rest = shared([r for r in rests if r])
        parts.append(word + (f"(?: {rest})?" if rest and [] in rests else f" {rest}" if rest else ""))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""


#: Any license's name; one that says that it is one, which may stand alone.
_NAMES = shared([n.split() for n in dict.fromkeys(n for _, names in licenses().values() for n in names)])
_TITLES = shared([n.split() for n in dict.fromkeys(n for _, names in licenses().values() for n in names if "license" in n.split() and len(n.split()) > 1)])


#: Sentences of texts and notices by identifier.
TEXTS = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-event": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "x11-name": "except as contained in this notice the name of holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from holder",
    "ncsa-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-no-event": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "pg-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "hpnd-grant": "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "neither the name of holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by holder as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-no-event": "in no event shall holder be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "apache1-ack": "the end user documentation included with the redistribution if any must include the following acknowledgment",
    "apache1-name": "products derived from this software may not be called apache nor may apache appear in their name without prior written permission of the apache software foundation",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-terms": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-url-s": "https www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "apache-title": "apache license version 2 0 january 2004",
    "apache-terms-title": "terms and conditions for use reproduction and distribution",
    "apache-contribution": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-definition": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "gnu-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gnu-copies": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl-preamble-2": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl-preamble-3": "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "lgpl-preamble": "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    "lgpl-3-body": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "agpl-preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "gpl-1-title": "gnu general public license version 1 february 1989", "gpl-2-title": "gnu general public license version 2 june 1991", "gpl-3-title": "gnu general public license version 3 29 june 2007",
    "lgpl-2-title": "gnu library general public license version 2 june 1991", "lgpl-2.1-title": "gnu lesser general public license version 2 1 february 1999", "lgpl-3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl-3-title": "gnu affero general public license version 3 19 november 2007", "gfdl-1.2-title": "gnu free documentation license version 1 2 november 2002", "gfdl-1.3-title": "gnu free documentation license version 1 3 3 november 2008",
    "gfdl-1.2-grant": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation",
    "gfdl-1.3-grant": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation",
    "gfdl-body": "this license applies to any manual or other work in any medium that contains a notice placed by the copyright holder saying it can be distributed under the terms of this license",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl-2-title": "mozilla public license version 2 0",
    "mpl-2-definition": "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "mpl-1.1-notice": "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license",
    "mpl-1.1-as-is": "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied",
    "mpl-1.1-definition": "commercial use means distribution or otherwise making the covered code available to a third party",
    "epl-1-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    "epl-2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl-2-notice-v": "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution",
    "epl-1-body": "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement",
    "epl-2-body": "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipients acceptance of this agreement",
    "cddl-notice": "the contents of this file are subject to the terms of the common development and distribution license",
    "eupl-notice": "you may not use this work except in compliance with the license",
    "cc0-notice": "to the extent possible under law holder has waived all copyright and related or neighboring rights to",
    "cc0-title": "cc0 1 0 universal",
    "cc0-body": "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s of an original work of authorship and or a database each a work",
    "cc-by-body": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license public license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl-title": "do what the fuck you want to public license",
    "wtfpl-grant": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-no-event": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "bsl-title": "boost software license version 1 0 august 17th 2003",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "artistic-1-preamble": "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications",
    "artistic-2-preamble": "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",
    "perl-terms": "this program is free software you can redistribute it and or modify it under the same terms as perl itself",
    "psf-grant": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using",
    "ofl-notice": "this font software is licensed under the sil open font license version 1 1",
    "ofl-grant": "permission is hereby granted free of charge to any person obtaining a copy of the font software to use study copy merge embed modify redistribute and sell modified and unmodified copies of the font software subject to the following conditions",
    "ms-pl-body": "this license governs use of the accompanying software if you use the software you accept this license",
    "odbl-notice": "this holder is made available under the open database license",
    "beerware": "as long as you retain this notice you can do whatever you want with this stuff",
    "busl-body": "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",
    "proprietary": "all rights reserved",
    "confidential": "this software is the confidential and proprietary information of holder",
    "no-copying": "unauthorized copying of this file via any medium is strictly prohibited",
    "no-part": "no part of this publication may be reproduced distributed or transmitted in any form or by any means",
    "public-domain": "this work is in the public domain",
    "public-domain-placed": "this file has been put into the public domain",
    "public-domain-dedicated": "dedicated to the public domain",
}

#: license (or none of its own), category and the identifiers that say it, in order of trial: longer before shorter ones.
_TEXT_RULES = (
    ("NCSA", ("ncsa-grant",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-event", "x11-name")), ("MIT", ("mit-grant", "mit-notice", "as-is", "no-event")), ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-grant",)),
    ("MIT-0", ("mit-0-grant", "as-is", "no-event")), ("MIT-0", ("mit-0-grant", "as-is")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-no-event")), ("ISC", ("isc-grant-and", "isc-as-is", "isc-no-event")), ("0BSD", ("0bsd-grant", "isc-as-is", "isc-no-event")), ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-and",)), ("0BSD", ("0bsd-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")), ("Apache-1.1", ("bsd-grant", "bsd-source", "bsd-binary", "apache1-ack")), ("Apache-1.1", ("apache1-name",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-no-event")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-event")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-grant", "apache-terms", "apache-copy", "apache-url", "apache-as-is", "apache-limits")), ("Apache-2.0", ("apache-grant", "apache-terms", "apache-copy", "apache-url-s", "apache-as-is", "apache-limits")),
    ("Apache-2.0", ("apache-grant", "apache-terms", "apache-copy")), ("Apache-2.0", ("apache-grant", "apache-terms")), ("Apache-2.0", ("apache-grant",)), ("Apache-2.0", ("apache-title",)), ("Apache-2.0", ("apache-definition",)), ("Apache-2.0", ("apache-contribution",)),
    ("LGPL-3.0", ("lgpl-3-title",)), ("LGPL-3.0", ("lgpl-3-body",)), ("LGPL-2.1", ("lgpl-2.1-title",)), ("LGPL-2.0", ("lgpl-2-title",)), ("LGPL-2.1", ("lgpl-preamble",)), ("AGPL-3.0", ("agpl-3-title",)), ("AGPL-3.0", ("agpl-preamble",)),
    ("GPL-3.0", ("gpl-3-title",)), ("GPL-3.0", ("gpl-preamble",)), ("GPL-2.0", ("gpl-2-title",)), ("GPL-1.0", ("gpl-1-title",)),
    ("GFDL-1.3", ("gfdl-1.3-title",)), ("GFDL-1.2", ("gfdl-1.2-title",)), ("GFDL-1.3", ("gfdl-1.3-grant",)), ("GFDL-1.2", ("gfdl-1.2-grant",)),
    ("MPL-2.0", ("mpl-2-notice", "mpl-2-copy")), ("MPL-2.0", ("mpl-2-notice",)), ("MPL-2.0", ("mpl-2-definition",)), ("MPL-2.0", ("mpl-2-title",)), ("MPL-1.1", ("mpl-1.1-notice", "apache-copy")), ("MPL-1.1", ("mpl-1.1-notice",)), ("MPL-1.1", ("mpl-1.1-definition",)),
    ("EPL-1.0", ("epl-1-notice",)), ("EPL-2.0", ("epl-2-notice",)), ("EPL-2.0", ("epl-2-notice-v",)), ("EPL-2.0", ("epl-2-body",)), ("EPL-1.0", ("epl-1-body",)), ("CDDL-1.0", ("cddl-notice",)), ("EUPL-1.2", ("eupl-notice",)),
    ("CC0-1.0", ("cc0-notice",)), ("CC0-1.0", ("cc0-title",)), ("CC0-1.0", ("cc0-body",)), ("CC-BY-4.0", ("cc-by-body",)), ("Unlicense", ("unlicense", "unlicense-grant")), ("Unlicense", ("unlicense",)), ("WTFPL", ("wtfpl-title", "wtfpl-grant")), ("WTFPL", ("wtfpl-title",)),
    ("Zlib", ("zlib-as-is", "zlib-no-event", "zlib-grant")), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("bsl-title", "bsl-grant")), ("BSL-1.0", ("bsl-title",)), ("BSL-1.0", ("bsl-grant",)), ("Artistic-1.0", ("artistic-1-preamble",)), ("Artistic-2.0", ("artistic-2-preamble",)),
    ("Artistic-1.0", ("perl-terms",)), ("Python-2.0", ("psf-grant",)), ("PostgreSQL", ("pg-grant",)), ("HPND", ("hpnd-grant",)), ("OFL-1.1", ("ofl-notice",)), ("OFL-1.1", ("ofl-grant",)), ("MS-PL", ("ms-pl-body",)), ("ODbL-1.0", ("odbl-notice",)), ("Beerware", ("beerware",)), ("BUSL-1.1", ("busl-body",)),
    ("Public-Domain", ("public-domain",)), ("Public-Domain", ("public-domain-placed",)), ("Public-Domain", ("public-domain-dedicated",)),
    ("Proprietary", ("confidential",)), ("Proprietary", ("no-copying",)), ("Proprietary", ("no-part",)),
)
#: Says that a license is reserved only where no other license is found.
LAST_RESORT = ("Proprietary", ("proprietary",))
_CATEGORIES = {"HPND": "permissive", "Public-Domain": "permissive", "Proprietary": "restricted"}

#: The same over lower-cased text, where lines and signs still tell fields, headings and alternatives.
LINE_FORMS = (
    # a field, as in a package's description or a tag of a source file
    ("licen[sc]es?(?:[- ]identifier)?[\\x22\\x27]?[ \\t]*[:=]+[ \\t>\\x22\\x27({\\[]*", " licensed under "),
    # a line that is nothing but a license's name
    (f"(^|\\n)[^a-z0-9\\n]*(?:the )?({_TITLES.replace(' ', '[- .]+')})[^a-z0-9\\n]*(?:[(][a-z0-9 .-]+[)][^a-z0-9\\n]*)?(\\n|$)", "$1 licensed under $2 $3"),
    ("\\b((?:mit|isc|bsd|l?gpl|apache)(?:[- ]?v?[0-9.]+)?)[ ]*/[ ]*(mit|isc|bsd|l?gpl|apache)\\b", "$1 or $2"),
)
#: (pattern, what takes its place) over normalised text, in order. Patterns are plain enough for other engines too.
FORMS = (
    ("\\blicence", "license"),
    ("\\bthis (?:library|software|file|package|project|code|work|module|script|tool|application|plugin) is (free software|distributed in the hope)", "this program is $1"),
    ("neither the names? of (?:[a-z0-9]+ ){1,12}?nor the names of (?:its|their|any) contributors", "neither the name of holder nor the names of its contributors"),
    ("this software is provided by (?:[a-z0-9]+ ){1,12}?as is and any", "this software is provided by holder as is and any"),
    ("in no event shall (?:[a-z0-9]+ ){1,16}?be liable for any direct", "in no event shall holder be liable for any direct"),
    ("the name of (?:[a-z0-9]+ ){1,8}?shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from(?: the [a-z]+ [a-z]+| [a-z0-9]+)", "the name of holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from holder"),
    ("to the extent possible under law (?:[a-z0-9]+ ){1,10}?has waived", "to the extent possible under law holder has waived"),
    ("confidential and proprietary information of [a-z0-9]+", "confidential and proprietary information of holder"),
    ("this [a-z0-9]+ is made available under the open database", "this holder is made available under the open database"),
    ("\\b(?:(?:licensed|released|distributed|available|published|provided|shared|offered) under|(?:licensed|covered|governed) by) (?:an? |the )?(?:terms (?:and conditions )?of )?(?:an? |the )?", "licensed under "),
    # weaker leads count before a name that says that it is a license's
    (f"\\b(?:see|uses?|using|subject to|under) (?:an? |the )?(?:terms (?:and conditions )?of )?(?:an? |the )?({_TITLES})\\b", "licensed under $1"),
    # several names: each is one, three more at most
    *[(f"\\b(licensed under {_NAMES}) (?:and or|or|and) (?:the |licensed under )?({_NAMES})\\b", "$1 licensed under $2")] * 3,
)
#: One of these begins a word in every text that has a known sentence.
ANCHORS = "(?<![a-z0-9])(?:licen[sc]|permission|copyright|warrant|distribut|advertising|permitted|rights[^a-z0-9]+reserved|public[^a-z0-9]+domain|without[^a-z0-9]+restriction|(?:released|distributed|available|published|provided|shared|offered)[^a-z0-9]+under[^a-z0-9]|(?:covered|governed)[^a-z0-9]+by[^a-z0-9]|free[^a-z0-9]+software|cc0|misrepresented|liable|confidential|prohibited|reproduced|you[^a-z0-9]+want|spdx|documentation|derived|commercial[^a-z0-9]+use|exclusive|contributor|exercising)"


def _notices() -> dict[str, tuple[str, str]]:
    """sentence: (identifier, license) of the notices of the GNU licenses."""
    out = {}
    for family, (names, versions) in _GNU.items():
        for name in names[:2] if family == "LGPL" else names[:1]:
            for v in versions:
                begin = f"this program is free software you can redistribute it and or modify it under the terms of the {name} "
                option = " or at your option any later version"
                for said in (f"as published by the free software foundation either version {v} of the license{option}", f"as published by the free software foundation either version {v}{option}", f"as published by the free software foundation version {v} of the license", f"version {v} as published by the free software foundation", f"version {v}"):
                    out[begin + said] = f"{family.lower()}-{v.replace(' ', '.')}-notice", _versioned(family, v)
    return out


def formed(sentence: str) -> str:
    """A normalised sentence in its one form."""
    for pattern, to in FORMS:
        sentence = re.sub(pattern, re.sub(r"[$](\d)", r"\\\1", to), sentence)
    return sentence


def sentences() -> dict[str, str]:
    """Normalised sentence in its one form: identifier, all of them."""
    out = {f"licensed under {n}": f"{name}-ref" for name, (_, names) in licenses().items() for n in names}
    out |= {s: i for s, (i, _) in _notices().items()}
    return {formed(s): i for s, i in (out | {s: i for i, s in TEXTS.items()}).items()}


def rules() -> list[tuple[str, str, tuple[str, ...]]]:
    """(license, category, identifiers) in order of trial; LAST_RESORT comes last."""
    known = licenses()
    category = {name: kind for name, (kind, _) in known.items()} | _CATEGORIES
    out = [(name, category[name], ids) for name, ids in _TEXT_RULES]
    notices = {i: name for i, name in _notices().values()}
    out += [(name, category[name], (i, "gnu-warranty")) for i, name in notices.items()] + [(name, category[name], (i,)) for i, name in notices.items()]
    out += [(name, category[name], (f"{name}-ref",)) for name in known]
    return [*out, (LAST_RESORT[0], category[LAST_RESORT[0]], LAST_RESORT[1])]
