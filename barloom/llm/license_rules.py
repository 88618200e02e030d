"""Signature rules of the license scan, in order of priority.

A rule reads a canonical text: lower-case words joined by single spaces, with punctuation gone, so "GPL-3.0" is
``gpl 3 0``. Each family below has its label, a keyword that any of its matches contains, a pattern of its name and its versions.
Four forms of sentence make the family rules: a tag with the name, a grant, the name with a version, and the bare name. SPDX has the
short ids that tags carry, each as the first, second and third operand of an expression. SENTENCES are written out one by one.
"""

from __future__ import annotations

from typing import NamedTuple

_L = "licen[cs]e"

#: Names that are words of their own: they need a tag, a grant or a version.
NOT_BARE = {r"apache"}

#: label, keyword, name, versions
FAMILIES: list[tuple[str, str, str, str]] = [
    ("agpl", "affero", rf"(?:gnu )?affero (?:general )?public {_L}", "1.0 3.0"),
    ("agpl", "agpl", r"(?:gnu )?agpl", "1.0 3.0"),
    ("lgpl", "lesser general", rf"(?:gnu )?lesser general public {_L}", "2.1 3.0"),
    ("lgpl", "library general", rf"(?:gnu )?library general public {_L}", "2.0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("gfdl", "free documentation", rf"(?:gnu )?free documentation {_L}", "1.1 1.2 1.3"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl", "1.1 1.2 1.3"),
    ("gpl", "general public licen", rf"(?:gnu )?general public {_L}", "1.0 2.0 3.0"),
    ("gpl", "gpl", r"(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("apache", "apache", rf"apache (?:software )?{_L}", "1.0 1.1 2.0"),
    ("apache", " apl", r"apl", "1.0 1.1 2.0"),
    ("apache", " asl", r"asl", "1.0 1.1 2.0"),
    ("apache", "apache", r"apache", "2.0"),
    ("mit-0", "mit no attribution", rf"mit no attribution(?: {_L})?", ""),
    ("mit", "mit licen", rf"(?:the )?mit {_L}", ""),
    ("mit", "expat licen", rf"expat {_L}", ""),
    ("x11", "x11 licen", rf"x11 {_L}", ""),
    ("bsd-0-clause", "0 clause bsd", rf"0 clause bsd(?: {_L})?", ""),
    ("bsd-2-clause", "2 clause bsd", rf"2 clause bsd(?: {_L})?", ""),
    ("bsd-2-clause", "bsd 2", rf"(?:simplified )?bsd 2 clause(?: {_L})?", ""),
    ("bsd-2-clause", "simplified bsd", rf"simplified bsd(?: {_L})?", ""),
    ("bsd-3-clause", "3 clause bsd", rf"3 clause bsd(?: {_L})?", ""),
    ("bsd-3-clause", "bsd 3", rf"bsd 3 clause(?: {_L})?", ""),
    ("bsd-3-clause", "bsd licen", rf"(?:new|modified|revised) bsd {_L}", ""),
    ("bsd-4-clause", "bsd 4", rf"bsd 4 clause(?: {_L})?", ""),
    ("bsd", "bsd licen", rf"bsd {_L}", ""),
    ("isc", "isc licen", rf"isc {_L}", ""),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_L}", ""),
    ("libpng", "libpng licen", rf"libpng {_L}", ""),
    ("bsl", "boost software licen", rf"boost software {_L}", "1.0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", "2.0"),
    ("wtfpl", "public licen", rf"do what the fuck you want to public {_L}", "2.0"),
    ("artistic", "artistic licen", rf"artistic {_L}", "1.0 2.0"),
    ("psf", "python software", rf"python software foundation {_L}", "2.0"),
    ("psf", "psf licen", rf"psf {_L}", "2.0"),
    ("php", "php licen", rf"php {_L}", "3.0 3.01"),
    ("ruby", "ruby licen", rf"ruby {_L}", ""),
    ("mpl", "mozilla public", rf"mozilla public {_L}", "1.0 1.1 2.0"),
    ("mpl", "mpl", r"mpl", "1.1 2.0"),
    ("epl", "eclipse public", rf"eclipse public {_L}", "1.0 2.0"),
    ("edl", "eclipse distribution", rf"eclipse distribution {_L}", "1.0"),
    ("cddl", "common development", rf"common development and distribution {_L}", "1.0 1.1"),
    ("cddl", "cddl", r"cddl", "1.0 1.1"),
    ("cpl", "common public licen", rf"common public {_L}", "1.0"),
    ("ipl", "ibm public", rf"ibm public {_L}", "1.0"),
    ("eupl", "european union", rf"european union public {_L}", "1.0 1.1 1.2"),
    ("eupl", "eupl", r"eupl", "1.1 1.2"),
    ("osl", "open software licen", rf"open software {_L}", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free", rf"academic free {_L}", "2.1 3.0"),
    ("ms-pl", "microsoft public", rf"microsoft public {_L}", ""),
    ("ms-rl", "microsoft reciprocal", rf"microsoft reciprocal {_L}", ""),
    ("ofl", "open font licen", rf"(?:sil )?open font {_L}", "1.0 1.1"),
    ("cc0", "cc0", r"cc0(?: universal)?", "1.0"),
    ("cc0", "creative commons", r"creative commons (?:zero|cc0)", "1.0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc by nc", r"cc by nc", "2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc by nd", r"cc by nd", "2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc by sa", r"cc by sa", "2.0 2.5 3.0 4.0"),
    ("cc-by", "cc by", r"cc by", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "creative commons", rf"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: \w+)?(?: {_L})?", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "creative commons", rf"creative commons attribution non ?commercial share ?alike(?: {_L})?", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "creative commons", rf"creative commons attribution non ?commercial(?: {_L})?", "2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "creative commons", rf"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: {_L})?", "2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "creative commons", rf"creative commons attribution share ?alike(?: {_L})?", "2.0 2.5 3.0 4.0"),
    ("cc-by", "creative commons", rf"creative commons attribution(?: {_L})?", "2.0 2.5 3.0 4.0"),
    ("odbl", "open database licen", rf"open database {_L}", "1.0"),
    ("odc-by", "open data commons", rf"open data commons attribution {_L}", "1.0"),
    ("pddl", "public domain", rf"public domain dedication and {_L}", "1.0"),
    ("sspl", "server side public", rf"server side public {_L}", "1.0"),
    ("busl", "business source", rf"business source {_L}", "1.1"),
    ("elastic", "elastic licen", rf"elastic {_L}", "2.0"),
    ("commons-clause", "commons clause", r"commons clause", "1.0"),
    ("vim", "vim licen", rf"vim {_L}", ""),
    ("tcl", " tcl", rf"tcl(?: tk)? {_L}", ""),
    ("postgresql", "postgresql licen", rf"postgresql {_L}", ""),
    ("openssl", "openssl licen", rf"openssl {_L}", ""),
    ("json", "json licen", rf"json {_L}", ""),
    ("beerware", "beer", rf"beer ?ware {_L}", ""),
    ("curl", "curl licen", rf"curl {_L}", ""),
    ("ntp", "ntp licen", rf"ntp {_L}", ""),
    ("unicode", "unicode licen", rf"unicode {_L}", ""),
    ("w3c", "w3c", rf"w3c (?:software (?:notice and )?)?{_L}", ""),
    ("zpl", "zope public", rf"zope public {_L}", "2.0 2.1"),
    ("sleepycat", "sleepycat", rf"sleepycat(?: public)? {_L}", ""),
    ("qpl", "q public", rf"q public {_L}", "1.0"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa (?:open source )?{_L}", ""),
    ("apsl", "apple public", rf"apple public source {_L}", "1.0 2.0"),
    ("cecill", "cecill", rf"cecill(?: free software)?(?: {_L})?", "1.0 2.0 2.1"),
    ("upl", "universal permissive", rf"universal permissive {_L}", "1.0"),
    ("blueoak", "blue oak", rf"blue oak model {_L}", "1.0.0"),
    ("ecl", "educational community", rf"educational community {_L}", "1.0 2.0"),
    ("mulan", "mulan", rf"mulan (?:permissive|public) (?:software )?{_L}", "1.0 2.0"),
    ("openrail", "rail", rf"(?:bigscience |creativeml )?open ?rail(?: [ms])?(?: {_L})?", ""),
    ("llama", "llama", rf"llama (?:\d )?(?:\d )?community {_L}", ""),
    ("proprietary", "proprietary", r"proprietary and confidential", ""),
    ("proprietary", "rights reserved", r"all rights reserved", ""),
    ("public-domain", "public domain", r"(?:released (?:in)?to|dedicated to|placed in|in) the public domain", ""),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", ""),
    ("permission-notice", "permission is hereby", r"permission is hereby granted(?: free of charge)?(?: to any person obtaining a copy)?", ""),
    ("redistribution-notice", "redistribution and use", r"redistribution and use in source and binary forms(?: with or without modification)?", ""),
    ("warranty-notice", "without warranty", r"without warranty of any kind(?: express or implied)?", ""),
    ("warranty-notice", "provided as is", r"(?:software is )?provided as is", ""),
]

#: Short ids of the SPDX list; the label is the id in lower case, or what follows the sign of equality. "-only", "-or-later" and "+"
#: are not part of an id here.
SPDX = """
0BSD=bsd-0-clause AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Adobe-2006
Adobe-Glyph Afmparse Aladdin Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0
BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear
BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-No-Military-License BSD-3-Clause-No-Nuclear-License BSD-3-Clause-Open-MPI
BSD-4-Clause BSD-4-Clause-Shortened BSD-4-Clause-UC BSD-Protection BSD-Source-Code BSL-1.0 BUSL-1.1 Beerware BitTorrent-1.0
BitTorrent-1.1 BlueOak-1.0.0 Borceux CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0
CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0
CC-BY-ND-4.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC=public-domain CC0-1.0 CDDL-1.0 CDDL-1.1
CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-1.1
CERN-OHL-1.2 CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CNRI-Python CPAL-1.0 CPL-1.0 CPOL-1.02 CUA-OPL-1.0 ClArtistic Condor-1.1
Crossword Cube DOC ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0 EUPL-1.1 EUPL-1.2 Elastic-2.0 Entessa
ErlPL-1.1 FSFAP FSFUL FSFULLR FTL Fair Frameworx-1.0 FreeImage GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 Giftware Glide
HPND HPND-sell-variant ICU IJG IPA IPL-1.0 ISC ImageMagick Imlib2 Info-ZIP Intel Interbase-1.0 JPNIC JSON JasPer-2.0 LAL-1.2 LAL-1.3
LGPL-2.0 LGPL-2.1 LGPL-3.0 LGPLLR LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c Latex2e Leptonica LiLiQ-P-1.1
LiLiQ-R-1.1 LiLiQ-Rplus-1.1 Libpng libpng-2.0 libtiff Linux-OpenIB MIT MIT-0 MIT-CMU MIT-Modern-Variant MIT-Wu MIT-advertising
MIT-enna MIT-feh MIT-open-group MITNFA MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MirOS Motosoto
MulanPSL-1.0=mulan-1.0 MulanPSL-2.0=mulan-2.0 Multics NASA-1.3 NCSA NGPL NLPL NOSL NPL-1.0 NPL-1.1 NPOSL-3.0 NTP NTP-0 Naumen
Net-SNMP NetCDF Nokia OCLC-2.0 ODC-By-1.0 ODbL-1.0 OFL-1.0 OFL-1.1 OGC-1.0 OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OGTSL OLDAP-2.7 OLDAP-2.8
OSET-PL-2.1 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 PSF-2.0 Parity-6.0.0 Parity-7.0.0
PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 PostgreSQL Python-2.0=psf-2.0 Python-2.0.1=psf-2.0 QPL-1.0 Qhull RPL-1.1
RPL-1.5 RPSL-1.0 RSCPL Ruby SAX-PD SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SHL-0.5 SHL-0.51 SISSL SISSL-1.2 SMLNJ SPL-1.0 SSPL-1.0 SimPL-2.0
Sleepycat Spencer-86 Spencer-94 Spencer-99 TCL TCP-wrappers TMate TORQUE-1.1 UCL-1.0 UPL-1.0 Unicode-3.0 Unicode-DFS-2015
Unicode-DFS-2016 Unicode-TOU Unlicense VSL-1.0 Vim W3C W3C-19980720 W3C-20150513 WTFPL Watcom-1.0 X11
X11-distribute-modifications-variant Xerox Xnet YPL-1.0 YPL-1.1 ZPL-1.1 ZPL-2.0 ZPL-2.1 Zend-2.0 Zimbra-1.3 Zlib
blessing bzip2-1.0.6 copyleft-next-0.3.0 copyleft-next-0.3.1 curl eCos-2.0 gSOAP-1.3b iMatix xinetd xpp zlib-acknowledgement
"""

_W = r"(?:[^ ]+ )"
_FSF = r"as published by the free software foundation "
_LATER = r"(?:either |only )?version "

#: label, keyword, sentence: what the licences themselves and the notices in files say.
SENTENCES: list[tuple[str, str, str]] = [
    ("mit", "any person obtaining a copy of this software",
     r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "substantial portions of the software",
     r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("x11", "shall not be used in advertising",
     rf"except as contained in this notice the names? of {_W}{{1,12}}?shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("json", "used for good not evil", r"the software shall be used for good not evil"),
    ("isc", "distribute this software for any purpose with or without fee",
     r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("bsd-0-clause", "distribute this software for any purpose with or without fee",
     r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "and its documentation for any purpose",
     r"permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose"),
    ("postgresql", "its documentation for any purpose without fee and without a written agreement",
     r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "redistributions of source code must retain",
     r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce",
     r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials"),
    ("bsd-3-clause", "to endorse or promote products derived from this software",
     rf"neither the names? of {_W}{{1,16}}?nor the names of (?:its|their|any) (?:own )?contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials mentioning features",
     r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "governed by a bsd style licen", rf"governed by a bsd style {_L} that can be found in the {_L} file"),
    ("zlib", "be held liable for any damages", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("libpng", "contributing authors and group 42", r"the contributing authors and group 42 inc disclaim all warranties"),
    ("bsl-1.0", "any person or organization obtaining a copy",
     r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "what the fuck you want to", r"you just do what the fuck you want to"),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("blessing", "may you do good and not evil", r"may you do good and not evil"),
    ("fsfap", "permitted in any medium without royalty",
     r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("fsful", "unlimited permission to copy",
     r"the free software foundation gives unlimited permission to copy and or distribute it"),
    ("apache-2.0", "under the apache licen",
     rf"licensed under the apache {_L} version 2 0 the {_L} you may not use this (?:file|software|work) except in compliance with the {_L}"),
    ("apache-2.0", "licenses license 2 0", r"https? www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual",
     rf"subject to the terms and conditions of this {_L} each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except)"),
    ("apache", "is distributed on an as is basis",
     rf"unless required by applicable law or agreed to in writing software distributed under the {_L} is distributed on an as is basis"),
    ("apache", "to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "developed by the apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "developed by the apache group", r"this product includes software developed by the apache group"),
    *[(f"{label}-{v}", f"{name} public licen", rf"under the terms of the gnu {name} public {_L} {_FSF}{_LATER}{at}(?: of the {_L})?(?: or at your option any later version)?")
      for label, name, vs in (("gpl", "general", "1.0 2.0 3.0"), ("lgpl", "lesser general", "2.1 3.0"),
                              ("lgpl", "library general", "2.0"), ("agpl", "affero general", "3.0"))
      for v in vs.split() for at in (v.replace(".", " ") if v == "2.1" else f"{v[0]}(?: 0)?",)],
    ("gpl", "gnu general public licen", rf"you should have received a copy of the gnu general public {_L} along with"),
    ("lgpl", "gnu lesser general public licen", rf"you should have received a copy of the gnu lesser general public {_L} along with"),
    ("lgpl", "gnu library general public licen", rf"you should have received a copy of the gnu library general public {_L} along with"),
    ("agpl", "gnu affero general public licen", rf"you should have received a copy of the gnu affero general public {_L} along with"),
    ("gpl", "copyleft licen", rf"the gnu general public {_L} is a free copyleft {_L} for software and other kinds of works"),
    ("gpl", "freedom to share and change", rf"gnu general public {_L} is intended to guarantee your freedom to share and change"),
    ("agpl", "cooperation with the community", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("fsf-notice", "hope that it will be useful", r"this (?:program|library|software|file) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-classpath-exception", "link this library with independent modules", r"permission to link this library with independent modules to produce an executable"),
    ("gfdl", "copy distribute and or modify this document", rf"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {_L}"),
    ("mpl-2.0", "subject to the terms of the mozilla public licen", rf"this source code form is subject to the terms of the mozilla public {_L} v 2 0"),
    ("mpl-2.0", "a copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "incompatible with secondary licen", r"this source code form is incompatible with secondary licen[cs]es"),
    ("mpl-1.1", "subject to the mozilla public licen", rf"the contents of this file are subject to the mozilla public {_L} version 1 1"),
    ("npl", "subject to the netscape public licen", rf"the contents of this file are subject to the netscape public {_L}"),
    ("epl", "accompanying program is provided under the terms of this eclipse", rf"the accompanying program is provided under the terms of this eclipse public {_L}"),
    ("cpl", "accompanying program is provided under the terms of this common", rf"the accompanying program is provided under the terms of this common public {_L}"),
    ("ipl", "accompanying program is provided under the terms of this ibm", rf"the accompanying program is provided under the terms of this ibm public {_L}"),
    ("cddl", "terms of the common development and distribution licen", rf"the contents of this file are subject to the terms of the common development and distribution {_L}"),
    ("eupl", "you may not use this work except in compliance with the licence", r"you may not use this work except in compliance with the licence"),
    ("artistic-2.0", "artistic licen", rf"you (?:can|may) (?:redistribute it and or modify it|use and distribute it) under the terms of the artistic {_L} (?:version )?2 0"),
    ("perl", "same terms as perl", r"you can redistribute it and or modify it under the same terms as perl(?: \d)?(?: itself)?"),
    ("psf", "psf is making python available", r"psf is making python available to licensee on an as is basis"),
    ("psf", "individual or organization licensee accessing", r"the python software foundation psf and the individual or organization licensee accessing and otherwise using"),
    ("php", "includes php", r"this product includes php software freely available from"),
    ("php-3.01", "subject to version 3 01 of the php", rf"this source file is subject to version 3 01 of the php {_L}"),
    ("openssl", "openssl project for use in the openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young"),
    ("ofl-1.1", "font software", rf"this font software is licensed under the sil open font {_L} version 1 1"),
    ("ofl", "neither the font software nor any of its individual components", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("cc0-1.0", "waived all copyright and related", r"waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "public domain by waiving all of", r"dedicated the work to the public domain by waiving all of (?:his or her|their) rights to the work"),
    ("cc0-1.0", "publicdomain zero", r"https? creativecommons org publicdomain zero 1 0"),
    *[(f"cc-{k}-{v}", f"licenses {k.replace('-', ' ')} {v.replace('.', ' ')}", rf"https? (?:www )?creativecommons org licenses {k.replace('-', ' ')} {v.replace('.', ' ')}")
      for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")],
    ("ogl-uk", "open government licen", rf"contains public sector information licensed under the open government {_L}"),
    ("ms-rl", "reciprocal grants", r"reciprocal grants for any file you distribute that contains code from the software"),
    ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction including without limitation the rights to use copy modify merge"),
    ("unicode", "unicode data files", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("curl", "distribute this software for any purpose with or without fee is hereby granted provided", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "portions of this software are copyright", r"portions of this software are copyright (?:c |© )?(?:[0-9]+ )*the freetype project"),
    ("sleepycat", "how to obtain complete source code for the db software", r"information on how to obtain complete source code for the db software"),
    ("lppl", "latex project public licen", rf"distributed and or modified under the conditions of the latex project public {_L}"),
    ("cecill", "abiding by the rules of distribution of free software", rf"governed by the cecill(?: [bc])? {_L} under french law and abiding by the rules of distribution of free software"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "right to sell the software", rf"the grant of rights under the {_L} will not include and the {_L} does not grant to you the right to sell the software"),
    ("upl-1.0", "a larger work to which the software is contributed", r"each a larger work to which the software is contributed by such licensors"),
    ("blueoak-1.0.0", "as much permission to work with this software", r"this license gives everyone as much permission to work with this software as possible"),
    ("mulan-2.0", "licensed under mulan psl v2", r"licensed under mulan psl v2"),
    ("openrail", "use based restrictions as referenced in paragraph 5", r"use based restrictions as referenced in paragraph 5"),
]

_GRANT = (r"(?:is |are )?(?:licensed|released|distributed|available|published|provided|redistribut\w+|covered|governed) "
          r"(?:by|under|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?")
_TAG = r"spdx license identifier "
#: What an id in an expression can look like.
_ID = (r"[a-z0-9]+(?: (?:[0-9]+[a-z]?|only|or later|by|nc|nd|sa|clause|clear|pl|rl|dfs|patent|psl|with (?:classpath|llvm|gcc) exception|"
       r"with linux syscall note))*")


class Rule(NamedTuple):
    rank: int
    label: str
    keyword: str
    pattern: str
    weight: float
    gate: str


def _version(v: str) -> str:
    """3.0 is written 3, 3 0, v3, v3 0 or version 3 0; 2.1 needs both numbers."""
    head, _, tail = v.partition(".")
    parts = tail.replace(".", " ")
    end = rf"(?: {parts})?" if not parts.strip("0 ") else rf" {parts}"
    return rf"(?: {_L})?(?: v| version)? ?{head}{end}(?: (?:only|or later|or any later version|international|unported))?"


def _spdx() -> list[tuple[int, str, str, str, float]]:
    """A tag of one id, and the second and third operands of an expression; these start a word later each, so none contains another."""
    rows = []
    for entry in SPDX.split():
        ident, _, label = entry.partition("=")
        name = ident.lower().replace("-", " ").replace(".", " ")
        end = f"{name}(?: only| or later)?"
        rows += [(0, label or ident.lower(), f"identifier {name}", _TAG + end, 1.0)]
        rows += [(0, label or ident.lower(), f" {name}", rf"{behind}identifier (?:{_ID} (?:or|and) ){{{n}}}{end}", 1.0)
                 for n, behind in ((1, "(?<= spdx )license "), (2, "(?<= spdx license )"))]
    return rows


def rules() -> list[Rule]:
    """All rules; a smaller rank has priority. The gate is a second keyword, shared by many rules."""
    rows = _spdx()
    for label, keyword, name, versions in FAMILIES:
        for v in versions.split():
            full = f"{label}-{v}"
            rows += [(0, full, keyword, _TAG + name + _version(v), 1.0), (1, full, keyword, _GRANT + name + _version(v), 1.0),
                     (2, full, keyword, name + _version(v), 0.9)]
        rows += [(3, label, keyword, _TAG + name, 0.9), (4, label, keyword, _GRANT + name, 0.8)]
        if name not in NOT_BARE:
            rows.append((5, label, keyword, name, 0.6))
    rows += [(2, label, keyword, sentence, 0.9) for label, keyword, sentence in SENTENCES]
    rows.sort(key=lambda r: r[0])

    return [Rule(k, label, keyword, rf"(?<= )(?:{pattern})(?= )", weight,
                 _TAG if rank in (0, 3) else keyword) for k, (rank, label, keyword, pattern, weight) in enumerate(rows)]


#: Every match of a rule contains one of these, so a text without any needs no rule.
STEMS = ("licen", "gpl", "gfdl", "apache", "mit no attribution", "bsd", "wtfpl", " mpl ", " mpl1", " mpl2", "eupl", "cddl", "cc0", "cc zero",
         "creative commons", "cc by", "commons clause", "cecill", "open rail", "openrail", "proprietary and", "rights reserved",
         "public domain", "copyright", "permission is hereby", "redistribution and use", "without warranty", "provided as is",
         " apl ", " apl1", " apl2", " asl ", " asl1", " asl2", "spdx", "altered source versions", "must not be misrepresented", "authors be held liable", "author be held liable",
         "distribute this software", "and its documentation for any purpose", "advertising materials mentioning", "used for good not evil",
         "to endorse or promote products", "contributing authors and group 42", "free and unencumbered", "anyone is free to copy",
         "what the fuck you want", "buy me a beer", "may you do good and not evil", "copying and distribution of this file",
         "free software foundation", "hope that it will be useful", "cooperation with the community", "with independent modules",
         "same terms as perl", "psf is making python", "includes php software", "openssl toolkit", "cryptographic software written",
         "font software", "publicdomain zero", "reciprocal grants for", "deal with the software without", "independent jpeg group",
         "source code for the db software", "hosted or managed service", "a larger work to which", "mulan psl",
         "use based restrictions", "advertising or otherwise to promote")
