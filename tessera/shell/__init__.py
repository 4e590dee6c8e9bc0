from tessera.shell.shell import Shell, print_table, row_count, run_script, split_statements

__all__ = ["Shell", "print_table", "row_count", "run_script", "split_statements"]
