"""Reports over growing inputs. An extension: the operators themselves are defined over whole captures."""
