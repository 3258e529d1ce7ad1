"""Hand-written rules of the licence scan: SPDX expressions, versioned names that
stand alone, texts of licences, their addresses and file headers.

Patterns are over lower-cased words joined by single blanks, as those of
``license_signatures``. Every rule names a keyword that begins a word of each of
its matches, and has an example that it finds and one that it has to leave alone.
"""

from __future__ import annotations

#: SPDX identifiers as words (fixed values): label, words, keyword.
SPDX: tuple[tuple[str, str, str], ...] = (
    ("0bsd", "0bsd", "0bsd"), ("aal", "aal", "aal"), ("afl-2.1", "afl 2 1", "afl"), ("afl-3.0", "afl 3 0", "afl"),
    ("agpl-3.0", "agpl 3 0(?: only)?", "agpl"), ("agpl-3.0-or-later", "agpl 3 0 or later", "agpl"),
    ("apache-1.0", "apache 1 0", "apache"), ("apache-1.1", "apache 1 1", "apache"),
    ("apache-2.0", "apache 2 0", "apache"), ("apsl-2.0", "apsl 2 0", "apsl"), ("artistic-1.0", "artistic 1 0", "artistic"),
    ("artistic-2.0", "artistic 2 0", "artistic"), ("blueoak-1.0.0", "blueoak 1 0 0", "blueoak"),
    ("bsd-1-clause", "bsd 1 clause", "bsd"), ("bsd-2-clause", "bsd 2 clause", "bsd"),
    ("bsd-2-clause-patent", "bsd 2 clause patent", "bsd"), ("bsd-3-clause", "bsd 3 clause", "bsd"),
    ("bsd-3-clause-clear", "bsd 3 clause clear", "bsd"), ("bsd-4-clause", "bsd 4 clause", "bsd"),
    ("bsl-1.0", "bsl 1 0", "bsl"), ("busl-1.1", "busl 1 1", "busl"), ("cc0-1.0", "cc0 1 0", "cc0"),
    ("cc-by", "cc by [1-4] 0", "cc"), ("cc-by-sa", "cc by sa [1-4] 0", "cc"), ("cc-by-nc", "cc by nc [1-4] 0", "cc"),
    ("cc-by-nd", "cc by nd [1-4] 0", "cc"), ("cc-by-nc-sa", "cc by nc sa [1-4] 0", "cc"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] 0", "cc"), ("cddl-1.0", "cddl 1 0", "cddl"), ("cddl-1.1", "cddl 1 1", "cddl"),
    ("cecill-2.1", "cecill 2 1", "cecill"), ("cecill-b", "cecill b", "cecill"), ("cecill-c", "cecill c", "cecill"),
    ("cpal-1.0", "cpal 1 0", "cpal"), ("cpl-1.0", "cpl 1 0", "cpl"), ("ecl-2.0", "ecl 2 0", "ecl"),
    ("efl-2.0", "efl 2 0", "efl"), ("epl-1.0", "epl 1 0", "epl"), ("epl-2.0", "epl 2 0", "epl"),
    ("eupl-1.1", "eupl 1 1", "eupl"), ("eupl-1.2", "eupl 1 2", "eupl"), ("gfdl", "gfdl 1 [1-3](?: only| or later)?", "gfdl"),
    ("gpl-1.0", "gpl 1 0(?: only)?", "gpl"), ("gpl-2.0", "gpl 2 0(?: only)?", "gpl"),
    ("gpl-2.0-or-later", "gpl 2 0 or later", "gpl"), ("gpl-3.0", "gpl 3 0(?: only)?", "gpl"),
    ("gpl-3.0-or-later", "gpl 3 0 or later", "gpl"), ("hpnd", "hpnd", "hpnd"), ("icu", "icu", "icu"),
    ("ijg", "ijg", "ijg"), ("ipl-1.0", "ipl 1 0", "ipl"), ("isc", "isc", "isc"), ("jasper-2.0", "jasper 2 0", "jasper"),
    ("lgpl-2.0", "lgpl 2 0(?: only)?", "lgpl"), ("lgpl-2.0-or-later", "lgpl 2 0 or later", "lgpl"),
    ("lgpl-2.1", "lgpl 2 1(?: only)?", "lgpl"), ("lgpl-2.1-or-later", "lgpl 2 1 or later", "lgpl"),
    ("lgpl-3.0", "lgpl 3 0(?: only)?", "lgpl"), ("lgpl-3.0-or-later", "lgpl 3 0 or later", "lgpl"),
    ("lpl-1.02", "lpl 1 02", "lpl"), ("lppl-1.3c", "lppl 1 3c", "lppl"), ("mit", "mit", "mit"), ("mit-0", "mit 0", "mit"),
    ("mpl-1.0", "mpl 1 0", "mpl"), ("mpl-1.1", "mpl 1 1", "mpl"), ("mpl-2.0", "mpl 2 0", "mpl"),
    ("ms-pl", "ms pl", "ms"), ("ms-rl", "ms rl", "ms"), ("mulanpsl-2.0", "mulanpsl 2 0", "mulanpsl"),
    ("ncsa", "ncsa", "ncsa"), ("odbl-1.0", "odbl 1 0", "odbl"), ("odc-by-1.0", "odc by 1 0", "odc"),
    ("ofl-1.1", "ofl 1 1", "ofl"), ("openssl", "openssl", "openssl"), ("osl-2.1", "osl 2 1", "osl"),
    ("osl-3.0", "osl 3 0", "osl"), ("pddl-1.0", "pddl 1 0", "pddl"), ("php-3.01", "php 3 01", "php"),
    ("postgresql", "postgresql", "postgresql"), ("python-2.0", "python 2 0", "python"), ("qpl-1.0", "qpl 1 0", "qpl"),
    ("ruby", "ruby", "ruby"), ("sissl", "sissl", "sissl"), ("sleepycat", "sleepycat", "sleepycat"),
    ("sspl-1.0", "sspl 1 0", "sspl"), ("unlicense", "unlicense", "unlicense"), ("upl-1.0", "upl 1 0", "upl"),
    ("vim", "vim", "vim"), ("w3c", "w3c", "w3c"), ("wtfpl", "wtfpl", "wtfpl"), ("x11", "x11", "x11"),
    ("zlib", "zlib", "zlib"), ("zpl-2.1", "zpl 2 1", "zpl"),
)

#: Exceptions that follow an SPDX identifier: label, words, keyword.
EXCEPTIONS: tuple[tuple[str, str, str], ...] = (
    ("classpath-exception", "classpath exception 2 0", "classpath"), ("llvm-exception", "llvm exception", "llvm"),
    ("gcc-exception", "gcc exception (?:2 0|3 1)", "gcc"), ("autoconf-exception", "autoconf exception [23] 0", "autoconf"),
    ("bison-exception", "bison exception 2 2", "bison"), ("font-exception", "font exception 2 0", "font"),
    ("linux-syscall-note", "linux syscall note", "linux"), ("openjdk-exception", "openjdk assembly exception 1 0", "openjdk"),
)

#: level, label, keyword, pattern, an example, a counterexample.
RULES: tuple[tuple[int, str, str, str, str, str], ...] = (
    # Short names with their version, in headers and package files.
    (2, "gpl-2.0", "gplv2", r"gplv2(?: 0)?(?: only)?", "GPLv2", "GPLv"),
    (2, "gpl-3.0", "gplv3", r"gplv3(?: 0)?(?: only)?", "GPLv3", "GPLv30"),
    (1, "gpl-2.0-or-later", "gplv2", r"gplv2 (?:or later|or any later version|or newer)", "GPLv2 or later", "GPLv2 or not"),
    (1, "gpl-3.0-or-later", "gplv3", r"gplv3 (?:or later|or any later version|or newer)", "GPLv3 or later", "GPLv3 or not"),
    (1, "gpl-2.0-or-later", "gnu", r"gnu gpl version 2 or (?:any )?later(?: version)?", "GNU GPL version 2 or later", "GNU GPL version 2 or none"),
    (1, "gpl-3.0-or-later", "gnu", r"gnu gpl version 3 or (?:any )?later(?: version)?", "GNU GPL version 3 or later", "GNU GPL version 3 or none"),
    (1, "gpl-2.0-or-later", "general", r"general public license (?:version|v) ?2 or (?:at your option )?any later version", "General Public License version 2 or any later version", "General Public License version 2 or any other"),
    (1, "gpl-3.0-or-later", "general", r"general public license (?:version|v) ?3 or (?:at your option )?any later version", "General Public License version 3 or any later version", "General Public License version 3 or any other"),
    (2, "gpl-2.0", "gpl", r"gpl v?2(?: 0)?", "GPL-2.0", "GPL-5"),
    (2, "gpl-3.0", "gpl", r"gpl v?3(?: 0)?", "GPL 3", "GPL 33"),
    (2, "lgpl-2.1", "lgplv2", r"lgplv2 1", "LGPLv2.1", "LGPLv2.4"),
    (2, "lgpl-3.0", "lgplv3", r"lgplv3(?: 0)?", "LGPLv3", "LGPLv33"),
    (2, "lgpl-2.1", "lgpl", r"lgpl v?2 1", "LGPL-2.1", "LGPL-2.6"),
    (2, "lgpl-3.0", "lgpl", r"lgpl v?3(?: 0)?", "LGPL 3.0", "LGPL 9"),
    (2, "agpl-3.0", "agplv3", r"agplv3(?: 0)?", "AGPLv3", "AGPLv4"),
    (2, "agpl-3.0", "agpl", r"agpl v?3(?: 0)?", "AGPL-3.0", "AGPL-8"),
    (2, "apache-2.0", "apache", r"apache v?2(?: 0)", "Apache-2.0", "Apache 2 servers"),
    (2, "apache-1.1", "apache", r"apache v?1 1", "Apache-1.1", "Apache 1 9"),
    (2, "mpl-2.0", "mpl", r"mpl v?2 0", "MPL-2.0", "MPL-7.0"),
    (2, "mpl-1.1", "mpl", r"mpl v?1 1", "MPL 1.1", "MPL 1.7"),
    (2, "epl-2.0", "epl", r"epl v?2 0", "EPL-2.0", "EPL-6.0"),
    (2, "epl-1.0", "epl", r"epl v?1 0", "EPL 1.0", "EPL 1.5"),
    (2, "eupl-1.2", "eupl", r"eupl v?1 2", "EUPL-1.2", "EUPL-9.2"),
    (2, "bsd-2-clause", "bsd", r"bsd 2(?: clause)", "BSD-2-Clause", "BSD 2 users"),
    (2, "bsd-3-clause", "bsd", r"bsd 3(?: clause)", "BSD-3-Clause", "BSD 3 users"),
    (2, "bsd-4-clause", "bsd", r"bsd 4(?: clause)", "BSD-4-Clause", "BSD 4 users"),
    (2, "cc0-1.0", "cc0", r"cc0 1 0", "CC0-1.0", "CC0-9"),
    (2, "cc-by-sa", "cc", r"cc by sa [1-4] 0", "CC BY-SA 4.0", "CC BY-SA 9.0"),
    (2, "cc-by-nc", "cc", r"cc by nc [1-4] 0", "CC-BY-NC-4.0", "CC-BY-NC-0"),
    (2, "bsl-1.0", "bsl", r"bsl 1 0", "BSL-1.0", "BSL-1.6"),
    (2, "busl-1.1", "business", r"business source license(?: 1 1)?", "Business Source License 1.1", "business source code"),
    (2, "sspl-1.0", "server", r"server side public license(?: v?1(?: 0)?)?", "Server Side Public License v1", "server side public key"),
    (2, "elastic-2.0", "elastic", r"elastic license(?: 2 0)?", "Elastic License 2.0", "elastic band"),
    (2, "ofl-1.1", "ofl", r"ofl 1 1", "OFL-1.1", "OFL-3"),
    (2, "odbl-1.0", "odbl", r"odbl 1 0", "ODbL-1.0", "ODbL 7"),
    (2, "upl-1.0", "universal", r"universal permissive license", "Universal Permissive License", "universal permissive rules"),
    (2, "ms-pl", "microsoft", r"microsoft public license", "Microsoft Public License", "Microsoft public cloud"),
    (2, "ms-rl", "microsoft", r"microsoft reciprocal license", "Microsoft Reciprocal License", "Microsoft reciprocal deal"),
    (2, "ncsa", "university", r"university of illinois ncsa open source license", "University of Illinois/NCSA Open Source License", "University of Illinois campus"),
    (2, "postgresql", "postgresql", r"postgresql license", "PostgreSQL License", "PostgreSQL server"),
    (2, "afl-3.0", "academic", r"academic free license(?: v?3(?: 0)?)?", "Academic Free License v3.0", "academic free lunch"),
    (2, "osl-3.0", "open", r"open software license(?: v?3(?: 0)?)?", "Open Software License 3.0", "open software market"),
    (2, "lppl", "latex", r"latex project public license", "LaTeX Project Public License", "LaTeX project files"),
    (2, "vim", "vim", r"vim license", "Vim License", "vim settings"),
    (2, "zpl-2.1", "zope", r"zope public license", "Zope Public License", "Zope public server"),
    (2, "cecill-2.1", "cecill", r"cecill(?: free software)? license", "CeCILL license", "cecill papers"),
    (2, "beerware", "beer", r"beer ?ware license", "Beer-ware License", "beer ware house"),
    (2, "beerware", "beerware", r"beerware license", "beerware license", "beerware mugs"),
    (2, "hippocratic-2.1", "hippocratic", r"hippocratic license", "Hippocratic License", "hippocratic oath"),
    (2, "openrail", "openrail", r"(?:creativeml )?openrail(?: m)?", "OpenRAIL-M", "openrails"),
    (2, "polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) license", "PolyForm Noncommercial License", "polyform shapes"),
    (2, "commons-clause", "commons", r"commons clause", "Commons Clause", "commons cause"),
    # Texts of licences.
    (1, "mit", "software", r"the software is provided as is without warranty of any kind express or implied", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "the software is provided by us without cost"),
    (1, "mit", "sublicense", r"copy modify merge publish distribute sublicense and or sell copies", "copy, modify, merge, publish, distribute, sublicense, and/or sell copies", "to sublicense it"),
    (1, "mit", "copyright", r"the above copyright notice and this permission notice shall be included in all copies", "The above copyright notice and this permission notice shall be included in all copies", "a copyright notice of ours"),
    (1, "bsd", "software", r"this software is provided by the copyright holders and contributors as is", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"", "this software is provided by the shop"),
    (1, "bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", "Redistributions of source code must retain the above copyright notice", "redistributions of wealth"),
    (1, "bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice", "redistributions in kind"),
    (1, "bsd-3-clause", "neither", r"neither the name of .{1,80}? nor the names of its contributors may be used", "Neither the name of the copyright holder nor the names of its contributors may be used", "neither the name nor the place"),
    (1, "bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", "All advertising materials mentioning features or use of this software", "advertising materials of ours"),
    (1, "isc", "software", r"the software is provided as is and the author disclaims all warranties", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES", "the author disclaims it"),
    (1, "0bsd", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "a fee is hereby due"),
    (1, "zlib", "altered", r"altered source versions must be plainly marked as such", "Altered source versions must be plainly marked as such", "altered plans"),
    (1, "zlib", "misrepresented", r"the origin of this software must not be misrepresented", "The origin of this software must not be misrepresented", "misrepresented facts"),
    (1, "apache-2.0", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org", "obtain a copy at apache org"),
    (1, "apache-2.0", "limitations", r"see the license for the specific language governing permissions and limitations under the license", "See the License for the specific language governing permissions and limitations under the License", "limitations of ours"),
    (1, "apache-2.0", "unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "unless required otherwise"),
    (1, "gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "you can redistribute it freely"),
    (1, "lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "you can redistribute it here"),
    (1, "agpl-3.0", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "you can redistribute it there"),
    (1, "gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |affero )?general public license", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License", "merchantability of goods"),
    (1, "mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "the Mozilla source code form"),
    (1, "epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v?2 0)?", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse of the sun"),
    (1, "unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain", "unencumbered land"),
    (1, "cc0-1.0", "waived", r"waived all copyright and related or neighboring rights", "waived all copyright and related or neighboring rights", "waived all fees"),
    (1, "wtfpl", "fuck", r"do what the fuck you want to public license", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "do what the fuck you want"),
    (1, "bsl-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "an organization of ours"),
    (1, "bsl-1.0", "boost", r"boost software license version 1 0", "Boost Software License - Version 1.0", "boost the engine"),
    (1, "ofl-1.1", "reserved", r"with reserved font name", "with Reserved Font Name", "reserved seats"),
    (1, "openssl", "openssl", r"this product includes software developed by the openssl project", "This product includes software developed by the OpenSSL Project", "the OpenSSL project team"),
    (1, "warranty-disclaimer", "warranties", r"(?:express or implied )?warranties including but not limited to the (?:implied )?warranties of merchantability", "warranties, including, but not limited to, the implied warranties of merchantability", "warranties of ours"),
    (1, "proprietary", "secrets", r"trade secrets (?:and|or) confidential information", "trade secrets and confidential information", "trade routes"),
    (1, "proprietary", "nondisclosure", r"nondisclosure agreement", "nondisclosure agreement", "nondisclosure of it"),
    # Addresses.
    (1, "mit", "mit", r"(?:https? )?mit license org", "https://mit-license.org", "mit license text"),
    (1, "mit", "opensource", r"opensource org licenses? mit(?: license)?(?: php)?", "https://opensource.org/license/mit", "opensource org home"),
    (1, "bsd-2-clause", "opensource", r"opensource org licenses? bsd 2 clause", "https://opensource.org/licenses/BSD-2-Clause", "opensource org bsd"),
    (1, "bsd-3-clause", "opensource", r"opensource org licenses? bsd 3 clause", "https://opensource.org/licenses/BSD-3-Clause", "opensource org news"),
    (1, "isc", "opensource", r"opensource org licenses? isc(?: license txt)?", "https://opensource.org/licenses/ISC", "opensource org isce"),
    (1, "apache-2.0", "opensource", r"opensource org licenses? apache 2 0", "https://opensource.org/licenses/Apache-2.0", "opensource org apache"),
    (1, "gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0", "https://www.gnu.org/licenses/old-licenses/gpl-2.0", "gnu org software"),
    (1, "gpl-3.0", "gnu", r"gnu org licenses gpl 3 0", "https://www.gnu.org/licenses/gpl-3.0", "gnu org gpl"),
    (1, "lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1", "https://www.gnu.org/licenses/old-licenses/lgpl-2.1", "gnu org lgpl"),
    (1, "lgpl-3.0", "gnu", r"gnu org licenses lgpl 3 0", "https://www.gnu.org/licenses/lgpl-3.0", "gnu org lists"),
    (1, "agpl-3.0", "gnu", r"gnu org licenses agpl 3 0", "https://www.gnu.org/licenses/agpl-3.0", "gnu org agpl"),
    (1, "mpl-1.1", "mozilla", r"mozilla org mpl mpl 1 1", "http://www.mozilla.org/MPL/MPL-1.1.html", "mozilla org news"),
    (1, "epl-2.0", "eclipse", r"eclipse org legal epl 2 0", "https://www.eclipse.org/legal/epl-2.0", "eclipse org downloads"),
    (1, "epl-1.0", "eclipse", r"eclipse org legal epl v10", "http://www.eclipse.org/legal/epl-v10.html", "eclipse org legal"),
    (1, "cc-by-nd", "creativecommons", r"creativecommons org licenses by nd [1-4] 0", "https://creativecommons.org/licenses/by-nd/4.0", "creativecommons org about"),
    (1, "cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa [1-4] 0", "https://creativecommons.org/licenses/by-nc-sa/4.0", "creativecommons org share"),
    (1, "cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd [1-4] 0", "https://creativecommons.org/licenses/by-nc-nd/4.0", "creativecommons org team"),
    (1, "unlicense", "unlicense", r"unlicense org", "https://unlicense.org", "unlicense files"),
    (1, "wtfpl", "wtfpl", r"wtfpl net", "http://www.wtfpl.net", "wtfpl network"),
    (1, "bsl-1.0", "boost", r"boost org license 1 0(?: txt)?", "https://www.boost.org/LICENSE_1_0.txt", "boost org docs"),
    (1, "ofl-1.1", "scripts", r"scripts sil org ofl", "https://scripts.sil.org/OFL", "scripts of ours"),
    (1, "odbl-1.0", "opendatacommons", r"opendatacommons org licenses odbl", "https://opendatacommons.org/licenses/odbl", "opendatacommons org"),
    (1, "pddl-1.0", "opendatacommons", r"opendatacommons org licenses pddl", "https://opendatacommons.org/licenses/pddl", "opendatacommons org news"),
    (1, "odc-by-1.0", "opendatacommons", r"opendatacommons org licenses by", "https://opendatacommons.org/licenses/by", "opendatacommons org faq"),
    (1, "eupl-1.2", "joinup", r"joinup ec europa eu .{0,60}?eupl", "https://joinup.ec.europa.eu/collection/eupl", "joinup ec europa eu"),
    (1, "spdx-url", "spdx", r"spdx org licenses", "https://spdx.org/licenses/MIT", "spdx org about"),
    # Headers and package files.
    (1, "mit", "classifier", r"classifier license osi approved mit license", "Classifier: License :: OSI Approved :: MIT License", "classifier of ours"),
    (1, "bsd", "classifier", r"classifier license osi approved bsd license", "Classifier: License :: OSI Approved :: BSD License", "classifier for bsd"),
    (1, "apache-2.0", "classifier", r"classifier license osi approved apache software license", "Classifier: License :: OSI Approved :: Apache Software License", "classifier on apache"),
    (2, "osi-approved", "osi", r"license osi approved", "License :: OSI Approved", "osi layers"),
    (3, "license-notice", "license", r"license (?:file|txt|md)", "LICENSE.txt", "license fee"),
    (3, "license-notice", "copying", r"copying (?:lesser|lib)", "COPYING.LESSER", "copying files"),
    (3, "copyright", "copyrighted", r"copyrighted (?:by|material)", "copyrighted material", "copyrighted"),
    (3, "trademark", "registered", r"(?:is|are) (?:a )?registered trademarks?", "is a registered trademark", "registered users"),
    (3, "dual-license", "dual", r"dual licensed", "dual-licensed", "dual use"),
    (3, "eula", "end", r"end user licen[cs]e agreement", "End User License Agreement", "end user"),
)


#: Keywords that stand inside very many words or texts, and a rarer word of the same rules.
CUES = {"end": "licen", "open": "licen", "dual": "licen", "osi": "licen", "vim": "licen", "server": "licen",
        "universal": "licen", "academic": "licen", "beer": "licen", "fee": "permission"}


def rule_rows() -> list[tuple[int, str, str, str, str]]:
    """(level, label, keyword, cue, pattern) of all rules of this module: an SPDX
    identifier counts as such behind the tag or an operator of a text with the tag."""
    rows = [(0, label, key, "spdx", rf"(?:identifier|or|and) {words}") for label, words, key in SPDX]
    rows += [(0, label, key, "spdx", rf"with {words}") for label, words, key in EXCEPTIONS]
    return rows + [(level, label, key, CUES.get(key, key), pattern) for level, label, key, pattern, _, _ in RULES]
