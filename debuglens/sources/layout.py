"""Binary layouts as struct formats, and bounds-checked reads over a memory view."""

from __future__ import annotations

import struct


class Malformed(ValueError):
    """Bytes that don't hold what their format says."""


class Layout:
    """Named fields of a fixed little-endian layout."""

    def __init__(self, code: str, names: str):
        self.struct, self.names = struct.Struct("<" + code), names.split()
        self.size = self.struct.size

    def read(self, data, offset: int, what: str = "record") -> dict:
        if offset < 0 or offset + self.size > len(data):
            raise Malformed(f"{what} out of bounds")
        return dict(zip(self.names, self.struct.unpack_from(data, offset)))

    def write(self, **values) -> bytes:
        return self.struct.pack(*(values.get(n, 0) for n in self.names))


ELF_HEADER = Layout("4s12sHHIIIIIHHHHHH", "magic ident type machine version entry phoff shoff flags ehsize phentsize phnum shentsize shnum shstrndx")
ELF_SECTION = Layout("10I", "name_offset type flags addr offset size link info alignment entry_size")
ELF_SEGMENT = Layout("8I", "type offset vaddr paddr filesz memsz flags align")
ELF_SYMBOL = Layout("IIIBBH", "name_offset value size info other shndx")
SYMBOLIC_HEADER = Layout(
    "hh23i",
    "magic version line_number_count line_numbers_size line_numbers_offset dense_numbers_count dense_numbers_offset procedure_descriptor_count procedure_descriptors_offset local_symbol_count local_symbols_offset optimization_symbols_count optimization_symbols_offset auxiliary_symbol_count auxiliary_symbols_offset local_strings_size local_strings_offset external_strings_size external_strings_offset file_descriptor_count file_descriptors_offset relative_file_descriptor_count relative_file_descriptors_offset external_symbols_count external_symbols_offset",
)
FILE_DESCRIPTOR = Layout("IiiiiiiiiiHHiiiiIii", "address path_offset strings_offset cb_ss symbol_base symbol_count line_base line_count optimization_base optimization_count procedure_first procedure_count aux_base aux_count rfd_base rfd_count bits line_offset line_size")
MDEBUG_SYMBOL = Layout("III", "string_offset value bits")
EXTERNAL_SYMBOL = Layout("HhIII", "flags file string_offset value bits")
PROCEDURE = Layout("IIiiiiiiihhiiI", "address symbol_index line_number_entry_index saved_register_mask saved_register_offset optimization_entry_index saved_float_register_mask saved_float_register_offset frame_size frame_pointer_register return_pc_register line_number_low line_number_high line_number_offset")
SNDLL_HEADER = Layout("13I", "magic relocations relocation_count symbols symbol_count elf_path load_func unload_func unknown_20 unknown_24 unknown_28 file_size unknown_30")
SNDLL_SYMBOL = Layout("IIBBBB", "string value unknown_8 unknown_9 type processed")
MDEBUG_MAGIC = 0x7009


def text_at(data, offset: int) -> str | None:
    """The zero-terminated string at offset, None if it doesn't end."""
    if not 0 <= offset < len(data):
        return None
    end = bytes(data).find(b"\0", offset) if not isinstance(data, (bytes, bytearray)) else data.find(b"\0", offset)
    return None if end < 0 else data[offset:end].decode("utf-8", "replace")
