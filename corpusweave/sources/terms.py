"""Keyword terms by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.text import normalize

# What the keyword search looks for, by category in report order.
TERMS = {
    "license": ["license", "all rights reserved", "permission", "eula", "COPYING.LIB"],
    "general": ["open source", "proprietary", "Inc.", "Register", "Visual Studio", "Visual C++", "Visual Basic", "mysql", "oracle", "sybase", "perl"],
    "custom": ["SPDX-License-Identifier", "SPDX", "copyleft", "bison", "invariants", "Classpath exception", "Autoconf exception", "Autoconf", "Bison exception", "Font exception", "GCC runtime library exception"],
    "license_name": [
        "apache", "Apache License", "Apple Public Source", "BitTorrent Open Source", "berkeley software distribution", "academic free license", "affero", "business source license", "Common Public Attribution",
        "Office Public", "Educational Community", "GNU Free Documentation", "General Public", "GNU General Public", "Free Software Foundation", "Interbase Public", "GNU Library General Public",
        "GNU Lesser General Public", "LaTeX Project Public", "Mozilla Public", "Mulan PSL", "Online Computer Library Center", "Open Software", "RealNetworks Public Source", "Sony Computer Entertainment",
        "SCEA Shared Source", "SGI Free Software", "Silicon Graphics", "Solderpad Hardware", "Sun Standards", "Sun Industry Standards Source", "Sun Public", "Server Side Public", "Transitive Grace Period Public",
        "THOR Public", "Upstream Compatibility", "World Wide Web Consortium", "3D Slicer", "Attribution Assurance", "APREAMBL", "Adobe Systems Incorporated", "Amazon Digital Services", "Aladdin Free Public",
        "Advanced Micro Devices", "Apple Computer, Inc", "NVIDIA Corporation", "Academy of Motion Picture Arts and Sciences", "The Apache Group", "Apache Software Foundation", "ADAPTIVE PUBLIC", "ARPHIC PUBLIC",
        "ASWF Digital Assets", "Solar Designer", "BEER-WARE", "Blue Oak Model", "Brian Gladman", "Boost Software", "Computational Use of Data Agreement", "Python Software Foundation",
    ],
    "license_abbreviation": [
        "AFL", "AGPL", "APL", "APSL", "BSD", "BSL", "BUSL", "CPAL", "CUA", "CUAPL", "ECL", "GFDL", "GPL", "IPL", "LGPL", "LPPL", "MPL", "PSL", "OCLC", "OSL", "RPSL", "SCEA", "SGI", "SHL", "SISSL", "SPL", "SSPL",
        "TGPPL", "TPL", "UCL", "W3C", "ASWF", "GPLv2", "GPLv2+", "GPLv3", "GPLv3+",
    ],
    "license_urls": [
        "gridengine.sunsource.net/license.html", "http://www.mongodb.com/licensing/server-side-public-license", "http://www.w3.org/Consortium/Legal/copyright-software", "http://www.apache.org/licenses/LICENSE-2.0",
        "https://www.gnu.org/licenses/", "http://www.bittorrent.com/license/", "www.mariadb.com/bsl11", "http://www.osedu.org/licenses/ECL-2.0", "http://www.Interbase.com/IPL.html", "http://www.latex-project.org/lppl.txt",
        "http://www.mozilla.org/MPL/", "https://mozilla.org/MPL/2.0/", "http://license.coscl.org.cn/MulanPSL", "http://license.coscl.org.cn/MulanPSL2", "http://www.oclc.org/research/",
        "https://www.helixcommunity.org/content/rpsl", "http://research.scea.com/scea_shared_source_license.html", "http://oss.sgi.com/projects/FreeB", "http://solderpad.org/licenses/SHL-0.5",
        "http://solderpad.org/licenses/SHL-0.51", "http://www.sun.com/", "https://www.openssl.org/source/license.html", "http://www.opensource.org/licenses/alphabetical", "http://www.apache.org/",
        "http://www.apache.org/licenses/", "http://www.apple.com/publicsource", "http://www.opensource.apple.com/apsl/", "https://blueoakcouncil.org/license/1.0.0", "http://gnu.org/licenses/gpl.html",
    ],
}

# Short phrases that name a licence.
PHRASES = {
    "Apache-2.0": ["Licensed under the Apache License 2.0", "licensed under the terms of the apache license version 2.0"],
    "MIT": ["licensed under the mit license"],
    "Python Software Foundation": ["Licensed to the Python Software Foundation under a contributor agreement"],
}


def frame(spark: SparkSession, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """(category, cat_ord, term_ord, term, norm) of a mapping from category to terms."""
    rows = [(c, i, j, t) for i, (c, ts) in enumerate((terms or TERMS).items()) for j, t in enumerate(ts)]
    return spark.createDataFrame(rows, "category string, cat_ord int, term_ord int, term string").withColumn("norm", normalize(F.col("term")))
