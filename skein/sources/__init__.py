"""Readers and writers: GFA, FASTA, FASTQ, reports."""
