"""Whole texts of common licences, as digests of their canonical form (see ``licenses``).

``DIGESTS`` are the long texts, with their length: with and without the appendix on how to apply them, with the
copyright line of an appendix filled in, with old and new addresses. The short ones are built here from
their usual wordings, in canonical form. A text whose names or wording differ otherwise is not known.
"""

from __future__ import annotations

import hashlib
from itertools import product

# Fixed values: (license, length of the canonical text, its SHA-256).
DIGESTS = (
    ("Apache-2.0", 8846, "d480e37408406341ec2e821878cd8c8cfac2683b1196a7ddd9a4d97d44f80ae4"),
    ("Apache-2.0", 8858, "296a35b4f3b6a7e90a68c08362fc50009807cd0dfd4f78f36f4062bd4d202555"),
    ("Apache-2.0", 8874, "4c492fa56676292284193a80e301d04b3a1bf951b2bf767845f7303c1f387eba"),
    ("Apache-2.0", 9890, "e54d72b4475d38e8ac691465cfb3533349778f63a32af127056c574c123b5dcf"),
    ("Apache-2.0", 9929, "d49070d0caf9f48d83c0fd2b314ebb13d12881e495867a48d1e524f570e04e29"),
    ("Apache-2.0", 9941, "835e996fe9c51d4f39c1ab0f41d78dfff82110dc6836d4b567546ff229729b37"),
    ("CC0-1.0", 6664, "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", 14450, "78e9c9f811bd1ba04ed6d619d3e51a759305d2f124cee9defa3535ba4a24bd25"),
    ("GPL-2.0", 14455, "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", 14456, "bdf38469899e13b914cf4555a4606ddcc8b2faddcedc662286f649b36212f225"),
    ("GPL-2.0", 14478, "b1abfb46077acd6c0450274e16fe4cb4610ec546c090c5977a069c5f74340774"),
    ("GPL-2.0", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", 14484, "3417af4a4eb07583be14c0185e9a1834057e320931de2c5bf39c217a03fe79a0"),
    ("GPL-2.0", 17155, "82a31b6bd81cf60dc59d8ce210d6d7cc114d4d6aebb39a315c8f460d44325760"),
    ("GPL-2.0", 17165, "7bdbeea9d2c2e7d87c63265fc479fd2a396a9c94e630ad8ac44e0fd6180d9c11"),
    ("GPL-2.0", 17167, "12960a14f2f6adf7ed77780324eb8b06178ffc1b001c7e61786df97200acdb1e"),
    ("GPL-3.0", 30940, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", 33454, "e4efe9434f2bb7fb35eea7820c9e7498501be88dfdedbcc70afece1ccc89c93f"),
    ("GPL-3.0", 33456, "198763e36e4f3417711d8e63ff17067a018b5dce6f8aa8558d671751faefb165"),
    ("LGPL-2.1", 23332, "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421"),
    ("LGPL-2.1", 23337, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", 23360, "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47"),
    ("LGPL-2.1", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", 25247, "148bb2bdb28edab385507689f03b1ec3fc9a06a993c441029a203c931b8633c5"),
    ("LGPL-2.1", 25257, "24a74220d661bec15705dceb6f7dac18c8746753e5a37c13da5f0150573e9858"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", 13669, "da79d8c581c2a42b486948b54a56ee2dd7a105d8eceaa4203dfe5e0433d433b3"),
    ("MPL-2.0", 14349, "797da5d4e9dafcb728632460f1b236d20d0aa8b1f838aa5911bd9f74276d611e"),
)

_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be "
    "held liable for any damages arising from the use of this software permission is granted to anyone to use "
    "this software for any purpose including commercial applications and to alter it and redistribute it "
    "freely subject to the following restrictions 1 the origin of this software must not be misrepresented "
    "you must not claim that you wrote the original software if you use this software in a product an "
    "acknowledgment in the product documentation would be appreciated but is not required 2 altered source "
    "versions must be plainly marked as such and must not be misrepresented as being the original software 3 "
    "this notice may not be removed or altered from any source distribution")
_BSL = (
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
    "software and accompanying documentation covered by this license the software to use reproduce display "
    "distribute execute and transmit the software and to prepare derivative works of the software and to "
    "permit third parties to whom the software is furnished to do so all subject to the following the "
    "copyright notices in the software and this entire statement including the above license grant this "
    "restriction and the following disclaimer must be included in all copies of the software in whole or in "
    "part and all derivative works of the software unless such copies or derivative works are solely in the "
    "form of machine executable object code generated by a source language processor the software is provided "
    "as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose title and non infringement in no event shall the "
    "copyright holders or anyone distributing the software be liable for any damages or other liability "
    "whether in contract tort or otherwise arising from out of or in connection with the software or the use "
    "or other dealings in the software")
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify "
    "publish use compile sell or distribute this software either in source code form or as a compiled binary "
    "for any purpose commercial or noncommercial and by any means in jurisdictions that recognize copyright "
    "laws the author or authors of this software dedicate any and all copyright interest in the software to "
    "the public domain we make this dedication for the benefit of the public at large and to the detriment of "
    "our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of "
    "all present and future rights to this software under copyright law the software is provided as is "
    "without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors be "
    "liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software")
_GRANT = (
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met")
_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BINARY = (
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution")
_ENDORSE = " may be used to endorse or promote products derived from this software without specific prior written permission"
_NAMES = (*(f"neither the name of {a} nor the names of {b} contributors{_ENDORSE}" for a, b in product(
    ("the copyright holder", "copyright holder", "the copyright holders", "the author", "the university"), ("its", "any"))),
    "the name of the author may not" + _ENDORSE[4:], "the names of its contributors may not" + _ENDORSE[4:])
_PROVIDED = (
    "this software is provided by {by} as is and any express or implied warranties including but not limited "
    "to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no "
    "event shall {no} be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability "
    "or tort including negligence or otherwise arising in any way out of the use of this software even if "
    "advised of the possibility of such damage")
_BY = (*((f"the copyright {a} and contributors", f"the copyright {b} or contributors") for a, b in product(
    ("holder", "holders"), ("holder", "holders", "owner"))), ("the author", "the author"),
    ("the author and contributors", "the author or contributors"), ("the regents and contributors", "the regents or contributors"))
_NUMBERS = (("1 ", "2 ", "3 "), ("", "", ""))
_BSD = ("", "bsd license ", "the bsd license ")
_BSD_2 = (*_BSD, "bsd 2 clause license ", "the bsd 2 clause license ", "the 2 clause bsd license ", "simplified bsd license ")
_BSD_3 = (*_BSD, "bsd 3 clause license ", "the bsd 3 clause license ", "the 3 clause bsd license ", "new bsd license ")


def short_texts() -> list[tuple[str, str]]:
    """``(license, canonical text)`` of the short licences, in their usual wordings."""
    out = [("Zlib", head + _ZLIB) for head in ("", "zlib license ", "the zlib license ", "zlib libpng license ", "the zlib libpng license ")]
    out += [("BSL-1.0", head + _BSL) for head in ("", "boost software license version 1 0 august 17th 2003 ")]
    out += [("Unlicense", head + _UNLICENSE + tail) for head, tail in product(
        ("", "unlicense ", "the unlicense "), ("", " for more information please refer to http unlicense org"))]
    for (x, y, z), (by, no) in product(_NUMBERS, _BY):
        conditions, end = f"{_GRANT} {x}{_SOURCE} {y}{_BINARY} ", _PROVIDED.format(by=by, no=no)
        out += [("BSD-2-Clause", head + conditions + end) for head in _BSD_2]
        out += [("BSD-3-Clause", f"{head}{conditions}{z}{name} {end}") for head, name in product(_BSD_3, _NAMES)]
    return out


def whole_texts() -> list[tuple[str, str, int]]:
    """``(digest, license, n_chars)`` of all whole texts."""
    return [(d, name, n) for name, n, d in DIGESTS] + [
        (hashlib.sha256(t.encode()).hexdigest(), name, len(t)) for name, t in short_texts()]
