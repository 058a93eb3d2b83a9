"""Wording of public licenses, as templates.

In a template [[ ... ]] may be left out, (( a | b )) is one of its parts, and <<k>> stands for up to k words of any kind. All
else is mandatory wording; case and marks don't count. TEXTS are the words that grant a license or disclaim its warranties,
NOTICES refer to a license by name.
"""

from __future__ import annotations

_AS_IS = (
    "this software is provided (( by <<12>> | )) as is and any express or implied warranties including but not limited to the implied warranties of merchantability and"
    " fitness for a particular purpose are disclaimed in no event shall <<12>> be liable for any direct indirect incidental special exemplary or consequential damages"
    " including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of"
    " liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of"
    " the possibility of such damage"
)
_BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [[ (( 1 | a )) ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [[ (( 2 | b )) ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"
    " and or other materials provided with the distribution"
)
_BSD_THIRD = "[[ (( 3 | c )) ]] neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_ISC_GRANT = "permission to use copy modify (( and or | and | )) distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    "the software is provided as is and (( the author | <<6>> )) disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
    " in no event shall (( the author | <<6>> )) be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
    " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
_GNU_NOTICE = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {name} [[ version <<2>> ]] as published by the free software foundation"
    " [[ either version <<3>> of the license or at your option any later version ]]"
)

#: Licensing words of each license, whole or by paragraph.
TEXTS: dict[str, list[str]] = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
        " copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " [[ the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software ]]",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular"
        " purpose and (( noninfringement | non infringement )) in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action"
        " of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "bsd-2-clause": [f"{_BSD_TWO} {_AS_IS}"],
    "bsd-3-clause": [f"{_BSD_TWO} {_BSD_THIRD}"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", _AS_IS],
    "isc": [f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd": [f"{_ISC_GRANT} {_ISC_AS_IS}"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " [[ 1 ]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment"
        " in the product documentation would be appreciated but is not required [[ 2 ]] altered source versions must be plainly marked as such and must not be misrepresented as being the"
        " original software [[ 3 ]] this notice may not be removed or altered from any source distribution"
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain [[ anyone is free to copy modify publish use compile sell or distribute this software either in source code form"
        " or as a compiled binary for any purpose commercial or non commercial and by any means ]]"
    ],
    "bsl-1.0": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use"
        " reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"
    ],
    "apache": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " [[ http www apache org licenses license 2 0 ]] [[ https www apache org licenses license 2 0 ]]"
        " [[ unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied ]]"
    ],
    "gpl": [_GNU_NOTICE.format(name="general public license")],
    "lgpl": [_GNU_NOTICE.format(name="(( lesser | library )) general public license")],
    "agpl": [_GNU_NOTICE.format(name="affero general public license")],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 [[ if a copy of the mpl was not distributed with this file you can obtain one at"
        " (( http | https )) (( mozilla | www mozilla )) org mpl 2 0 ]]"
    ],
    "cc0": ["to the extent possible under law <<8>> (( has | have )) waived all copyright and related or neighboring rights"],
}

_UNDER = "(( licensed | released | distributed | available )) under [[ the terms of ]] [[ the ]]"
_VERSION = "(( 1 0 | 2 0 | 2 1 | 2 5 | 3 0 | 4 0 ))"
_CREATIVE = {
    "cc-by": ("attribution", "by"),
    "cc-by-sa": ("attribution (( sharealike | share alike ))", "by sa"),
    "cc-by-nd": ("attribution (( noderivs | noderivatives | no derivatives ))", "by nd"),
    "cc-by-nc": ("attribution (( noncommercial | non commercial ))", "by nc"),
    "cc-by-nc-sa": ("attribution (( noncommercial | non commercial )) (( sharealike | share alike ))", "by nc sa"),
    "cc-by-nc-nd": ("attribution (( noncommercial | non commercial )) (( noderivs | noderivatives | no derivatives ))", "by nc nd"),
}

#: How texts name each license.
NOTICES: dict[str, list[str]] = {
    "mit": [f"{_UNDER} mit (( license | licence ))", "spdx license identifier mit"],
    "bsd": [f"{_UNDER} (( new | modified | simplified | )) bsd (( 2 clause | 3 clause | )) (( license | licence ))"],
    "isc": [f"{_UNDER} isc (( license | licence ))"],
    "apache": [f"{_UNDER} apache (( license | licence ))", "spdx license identifier apache 2 0"],
    "gpl": ["gnu general public license", "gnu gpl"],
    "lgpl": ["gnu (( lesser | library )) general public license", "gnu lgpl"],
    "agpl": ["gnu affero general public license", "gnu agpl"],
    "mpl": ["mozilla public license"],
    "bsl-1.0": ["boost software license"],
    "unlicense": [f"{_UNDER} unlicense"],
    "cc0": ["cc0 1 0 universal", f"{_UNDER} cc0"],
    **{k: [f"creative commons {name} [[ {_VERSION} ]] (( international | unported | generic | )) [[ public ]] (( license | licence ))", f"cc {code} {_VERSION}", f"creative commons {name} {_VERSION}"] for k, (name, code) in _CREATIVE.items()},
    "all-rights-reserved": ["copyright <<8>> all rights reserved"],
}
