"""Small sequence files, written at test time."""

SMALL = ">seq1\nACGTACGT\n>seq2\nMTEYKLVVVG\n>seq3\nNNNNACGT\n>seq4\nPEPTIDE\n>seq5\nGATTACA\n"
LONG = "MKTAYIAKQRQISFVKSHFSRQDILDLWQ"
GP = "GP" * 14 + "G"
CLUSTERS = f">seq1\n{LONG}\n>seq2\n{LONG}\n>seq3\n{LONG[:-1]}R\n>seq4\n{GP}\n>seq5\n{GP[:-2]}PA\n"
SHIFTED = f">ins_ref\n{'A' * 10}{'C' * 10}{'G' * 10}{'T' * 10}\n>ins_shifted\nQQ{'A' * 10}{'C' * 10}{'G' * 10}{'T' * 10}\n>other\n{'P' * 40}\n"
QUERIES = ">q1\nACGTACGT\n>q2\nMTEYKLVVVG\n"
FASTQ = "@r1\nACGTN\n+\nIIIII\n@r2\nMTEYK\n+\nIIIII\n@r3\nGATTA\n+\nIIIII\n"


def parse(text):
    out = []
    for line in text.splitlines():
        if line.startswith(">"):
            out.append([line[1:], ""])
        else:
            out[-1][1] += line
    return out


def frame(spark, text):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(parse(text))], "seq_id long, name string, seq string")
