"""Reading landing data and object stores; writing results and listings."""
