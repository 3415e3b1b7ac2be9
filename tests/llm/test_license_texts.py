"""Whole license texts: two clauses aren't three, numbers before clauses are free, mandatory wording isn't."""

from emberlog.llm import licenses

HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'


def test_two_and_three_clauses(spark):
    texts = [HEAD + ONE + TWO + TAIL, HEAD + ONE + TWO + THREE + TAIL, (HEAD + ONE + TWO + TAIL).replace("1. ", "* ").replace("2. ", "* "), (HEAD + ONE + TWO + TAIL).replace("must retain", "may retain"), HEAD + ONE]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(frame).orderBy("doc_id").collect()] == ["bsd-2", "bsd-3", "bsd-2", "", ""]
