"""Schemas of the data model. Coordinates are 0-based and half-open; files with 1-based ones are converted at the edge."""

CIGAR = "array<struct<op:string,len:int>>"
READS = f"read_id long, qname string, flag int, chrom string, pos long, mapq int, cigar {CIGAR}, seq string, qual array<int>, mate_chrom string, mate_pos long, xg string, nh int"
CONTIGS = "tid int, chrom string, length long"
#: A contig cut into chunks; `start` is the position of the first base of `seq`.
GENOME = "tid int, chrom string, length long, start long, seq string"
REGIONS = "chrom string, start long, end long, strand byte"
MAPPABILITY = "chrom string, start long, end long, value int"
BEDGRAPH = "chrom string, start long, end long, pct int, n_meth long, n_unmeth long"
SITES = "chrom string, pos long, base string, context string, tnc string"
