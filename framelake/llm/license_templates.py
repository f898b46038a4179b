"""Licence texts, standard headers and statements that ``licenses`` compares with.

Texts are kept as files beside this one; a file's name is the name of its licence.
"""

from __future__ import annotations

from pathlib import Path

#: Whole licences by name.
TEXTS: dict[str, str] = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
#: Standard headers and paragraphs of which each one names its licence.
HEADERS: list[tuple[str, str]] = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    *[(f"GPL-{v}.0", _GNU.format(what="program", name="General Public License", v=v)) for v in (1, 2, 3)],
    *[(f"LGPL-{v}", _GNU.format(what="library", name="Lesser General Public License", v=v)) for v in ("2.1", "3.0")],
    ("LGPL-2.0", _GNU.format(what="library", name="Library General Public License", v=2)),
    ("AGPL-3.0", _GNU.format(what="program", name="Affero General Public License", v=3)),
    *[(f"GFDL-{v}", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {v} or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.") for v in ("1.2", "1.3")],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'),
    *[(k, p) for k, start in (("MIT", "Permission is hereby"), ("ISC", "Permission to use"), ("Zlib", "Permission is granted"), ("Unlicense", "This is free"), ("Unlicense", "In jurisdictions")) for p in TEXTS[k].split("\n\n") if p.startswith(start)],
]

#: (licence, statement, words of it that a line must have). A family without a version is a licence name of its own.
STATEMENTS: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", "Released under the MIT License.", ("mit",)),
    ("MIT", "MIT License", ("mit",)),
    ("ISC", "Licensed under the ISC License.", ("isc",)),
    ("ISC", "ISC License", ("isc",)),
    ("Zlib", "zlib License", ("zlib",)),
    ("Unlicense", "The Unlicense", ("unlicense",)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache", "2")),
    *[(f"BSD-{n}-Clause", f"BSD {n}-Clause License", ("bsd", str(n))) for n in (2, 3)],
    ("BSD", "Licensed under the BSD License.", ("bsd",)),
    *[(f"GPL-{v}.0", s.format(v=v), keys + (str(v),)) for v in (1, 2, 3) for s, keys in (("This work is licensed under the GNU General Public License, version {v}.", ("gnu", "general")), ("GNU General Public License version {v}", ("gnu", "general")), ("Licensed under the GPL, version {v}.", ("gpl",)), ("GPLv{v}", ("gplv",)))],
    ("GPL", "GNU General Public License", ("gnu", "general")),
    *[(f"LGPL-{v}", s.format(v=v), keys + (v[0],)) for v in ("2.1", "3.0") for s, keys in (("This work is licensed under the GNU Lesser General Public License, version {v}.", ("lesser",)), ("GNU Lesser General Public License version {v}", ("lesser",)), ("Licensed under the LGPL, version {v}.", ("lgpl",)))],
    ("LGPL-2.0", "GNU Library General Public License version 2", ("library", "gnu", "2")),
    ("LGPL", "GNU Lesser General Public License", ("lesser",)),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("affero",)),
    ("AGPL-3.0", "GNU Affero General Public License version 3", ("affero",)),
    *[(f"GFDL-{v}", f"GNU Free Documentation License version {v}", ("documentation", "gnu", v[2])) for v in ("1.2", "1.3")],
    *[(f"MPL-{v}", f"Mozilla Public License Version {v}", ("mozilla", v[0])) for v in ("1.1", "2.0")],
    ("MPL", "Mozilla Public License", ("mozilla",)),
    ("Artistic-1.0-Perl", "The Artistic License", ("artistic",)),
    ("CC0-1.0", "CC0 1.0 Universal", ("cc", "universal")),
    *[(f"CC-{k}-4.0", s.format(k=k), ("cc", *k.lower().split("-"), "4")) for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for s in ("Licensed under CC {k} 4.0.", "CC {k} 4.0")],
    *[(f"CC-{k}-4.0", f"Creative Commons {n} 4.0 International License", ("creative", "attribution", *words)) for k, n, words in (("BY", "Attribution", ()), ("BY-SA", "Attribution-ShareAlike", ("sharealike",)), ("BY-ND", "Attribution-NoDerivatives", ("noderivatives",)), ("BY-NC", "Attribution-NonCommercial", ("noncommercial",)), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", ("noncommercial", "sharealike")), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", ("noncommercial", "noderivatives")))],
    ("Proprietary", "All rights reserved.", ("rights", "reserved")),
    ("Proprietary", "Copyright (c). All rights reserved.", ("rights", "reserved")),
]
#: Licences of which a line is the weakest statement: other matches of the file come before them.
WEAK = ("BSD", "GPL", "LGPL", "MPL", "Proprietary")
