"""Licence wordings as templates: label, then markup.

Words count, in lower case; signs between them do not. [[...]] may be left out, {{2-9}} stands for two to nine words of any
kind, {{a b|c}} for one of the wordings listed. Regions may be nested in optional ones.
"""

from __future__ import annotations

# fixed values: the wording of licences and of their customary notices
NOTICES = [
    ("mit", "{{released|licensed|distributed|available|provided}} under the [[terms of the]] MIT {{license|licence}}"),
    ("mit", "SPDX License Identifier MIT"),
    ("mit", """
        [[The MIT License [[MIT]]]] [[Copyright [[c]] {{1-20}}]]
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, {{sublicense|sublicence}}, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all
        copies or substantial portions of the Software.
        [[The software is provided "as is", without warranty of any kind, express or implied, including but not limited to
        the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall
        {{1-12}} be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise,
        arising from, out of or in connection with the software or the use or other dealings in the software.]]"""),
    ("apache-2.0", "Licensed under the Apache License, Version {{2.0|2}}"),
    ("apache-2.0", "SPDX License Identifier Apache 2.0"),
    ("apache-2.0", """
        [[Copyright {{1-20}}]]
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at {{1-8}}
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("gpl", "licensed under the [[terms of the]] [[GNU]] General Public License [[version {{2|2.0|3|3.0}} [[or later]]]]"),
    ("gpl-2.0", "SPDX License Identifier GPL 2.0 [[{{only|or later}}]]"),
    ("gpl-3.0", "SPDX License Identifier GPL 3.0 [[{{only|or later}}]]"),
    ("gpl-2.0", "GNU General Public License [[as published by the Free Software Foundation]] [[either]] {{version|v}} {{2|2.0}}"),
    ("gpl-3.0", "GNU General Public License [[as published by the Free Software Foundation]] [[either]] {{version|v}} {{3|3.0}}"),
    ("gpl", """
        is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation[[, either]] version {{2|3}} of the License[[, or (at your option) any later version]].
        [[{{1-6}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.]]"""),
    ("lgpl", "GNU {{lesser|library}} General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("cc-by", "licensed under [[a]] {{cc|creative commons}} {{by|attribution}} {{1|2|3|4}} 0 [[international]] [[license]]"),
    ("cc-by-sa", "licensed under [[a]] {{cc|creative commons}} {{by sa|attribution sharealike}} {{1|2|3|4}} 0 [[international]] [[license]]"),
    ("cc-by-nc", "licensed under [[a]] {{cc|creative commons}} {{by nc|attribution noncommercial}} {{1|2|3|4}} 0 [[international]] [[license]]"),
    ("cc-by-nd", "licensed under [[a]] {{cc|creative commons}} {{by nd|attribution noderivatives}} {{1|2|3|4}} 0 [[international]] [[license]]"),
    ("cc-by-nc-sa", "licensed under [[a]] {{cc|creative commons}} {{by nc sa|attribution noncommercial sharealike}} {{1|2|3|4}} 0 [[international]] [[license]]"),
    ("cc-by-nc-nd", "licensed under [[a]] {{cc|creative commons}} {{by nc nd|attribution noncommercial noderivatives}} {{1|2|3|4}} 0 [[international]] [[license]]"),
    ("cc0", "{{dedicated|released}} {{to|into}} the public domain [[{{under|using|via}}]] {{cc0|creative commons zero}} [[1 0]] [[universal]]"),
    ("bsd", "{{released|licensed|distributed}} under the [[terms of the]] [[{{2|3|new|simplified|revised}} [[clause]]]] BSD {{license|licence}}"),
    ("bsd-2-clause", """
        [[Copyright [[c]] {{1-20}} [[All rights reserved.]]]]
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. This software is provided by {{1-12}} "as is" and any express or implied warranties"""),
    ("bsd-3-clause", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. [[3.]] Neither the name of {{1-12}} nor the names of {{its|other}} contributors may be used
        to endorse or promote products derived from this software without specific prior written permission."""),
    ("isc", """
        [[ISC License]] [[Copyright [[c]] {{1-20}}]]
        Permission to use, copy, modify, {{and or|and|or}} distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        [[The software is provided "as is" and {{1-4}} disclaims all warranties with regard to this software including all
        implied warranties of merchantability and fitness.]]"""),
    ("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions:"""),
    ("mpl-2.0", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. [[If a copy of the MPL was not
        distributed with this file, You can obtain one at {{1-6}}]]"""),
    ("unlicense", """
        This is free and unencumbered software released into the public domain. [[Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.]]"""),
]

# fixed values: phrases that name a licence by themselves
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
