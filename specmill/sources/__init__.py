"""Inputs and outputs: rule files, document files, page tables, snapshot tables."""
