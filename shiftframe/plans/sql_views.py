"""SQL text of the derived views, for the comparison with a second engine. A view may use those above it."""

VIEWS = {
    "engine_results": """
        SELECT m.mol_id, e.engine, CAST(CASE WHEN m.mol_id % 4 = 1 THEN 4 - e.engine_pos ELSE e.engine_pos END AS INTEGER) AS engine_pos,
               CASE WHEN e.engine='cdk' AND m.mol_id % 13 = 0 THEN 'error'
                    WHEN e.engine='cascade' AND m.mol_id % 11 = 0 THEN 'error'
                    WHEN e.engine='orca' AND m.mol_id % 7 = 0 THEN 'pending' ELSE 'ok' END AS status
        FROM (SELECT DISTINCT l_orderkey AS mol_id FROM lineitem) m
        CROSS JOIN (VALUES ('cdk',1),('cascade',2),('orca',3)) AS e(engine, engine_pos)
    """,
    "predictions": """
        SELECT a.mol_id, a.atom_index, e.engine, e.engine_pos, e.status,
               a.base + CASE e.engine WHEN 'cdk' THEN CAST(0 AS double) WHEN 'cascade' THEN a.disc*20-1 ELSE a.tax*25-1 END AS shift_ppm
        FROM (SELECT l_orderkey AS mol_id, l_linenumber-1 AS atom_index, min(l_extendedprice) % CAST(220 AS double) AS base,
                     min(l_discount) AS disc, min(l_tax) AS tax
              FROM lineitem GROUP BY l_orderkey, l_linenumber) a
        JOIN engine_results e ON a.mol_id = e.mol_id
        WHERE NOT (e.engine='orca' AND a.atom_index % 3 = 2)
    """,
    "atoms": """
        SELECT mol_id, atom_index,
               CASE k WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 8 ELSE 1 END AS atomic_num,
               CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'C' WHEN 2 THEN 'O' ELSE 'H' END AS symbol,
               flag='A' AS is_aromatic, st='O' AS is_sp3,
               CASE WHEN sk % 11 = 0 THEN 1 WHEN sk % 13 = 0 THEN -1 ELSE 0 END AS formal_charge,
               CASE WHEN sk % 17 = 0 THEN 1 ELSE 0 END AS radicals, x, y, z
        FROM (SELECT l_orderkey AS mol_id,
                     CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_quantity, l_linenumber) - 1 AS int) AS atom_index,
                     l_partkey % 5 AS k, l_suppkey AS sk, l_returnflag AS flag, l_linestatus AS st,
                     l_extendedprice % CAST(6 AS double) AS x, l_quantity % CAST(5 AS double) AS y, l_discount*30 AS z
              FROM lineitem) t
    """,
    "bonds": """
        SELECT mol_id, atom_index AS bond_idx, CAST(floor((atom_index-1)/2.0) AS int) AS a, atom_index AS b,
               CASE WHEN is_aromatic THEN 'AROMATIC' WHEN is_sp3 THEN 'SINGLE' ELSE 'DOUBLE' END AS bond_type,
               NOT is_sp3 AS is_conjugated, is_aromatic AS in_ring
        FROM atoms WHERE atom_index > 0
    """,
    "protons": """
        SELECT mol_id,
               CAST(row_number() OVER (PARTITION BY mol_id ORDER BY ep, lk, sk, q, ln) - 1 AS int) AS atom_index,
               'h@' || CAST(ln % 2 AS string) AS assignment_group, (ep % CAST(9 AS double))/4 AS shift_ppm,
               CASE (lk + sk) % 4 WHEN 0 THEN 's' WHEN 1 THEN 'd' WHEN 2 THEN 't' ELSE 'm' END AS multiplicity,
               CASE WHEN (lk + sk) % 4 IN (1, 2) THEN CAST(7 AS double) END AS coupling_hz
        FROM (SELECT l_orderkey AS mol_id, l_extendedprice AS ep, l_partkey AS lk, l_suppkey AS sk, l_quantity AS q, l_linenumber AS ln FROM lineitem) t
    """,
    "conformers": """
        SELECT user_id AS mol_id, event_id AS conf_id, value/50 AS energy_kcal,
               CASE WHEN event_id % 9 = 0 THEN -1 ELSE 0 END AS flag
        FROM events
    """,
    "conformer_shifts": """
        SELECT c.mol_id, c.conf_id, a.atom_index, CAST((c.conf_id*7 + a.atom_index*31) % 220 AS double) AS shift_ppm
        FROM conformers c CROSS JOIN (VALUES (0),(1),(2)) AS a(atom_index)
    """,
    "reference_sigma": """
        SELECT functional, basis, nucleus, CAST(sigma AS double) AS sigma
        FROM (VALUES ('pbe','def2-svp','1H',31.8),('pbe','def2-svp','13C',188.1),('b3lyp','def2-tzvp','1H',31.6)) AS r(functional, basis, nucleus, sigma)
    """,
    "shieldings": """
        SELECT mol_id, atom_index, atomic_num, CASE mol_id % 3 WHEN 0 THEN ' PBE ' WHEN 1 THEN 'pbe' ELSE 'B3LYP' END AS functional,
               CASE mol_id % 3 WHEN 2 THEN 'def2-TZVP' ELSE 'def2-SVP' END AS basis,
               CASE WHEN (mol_id + atom_index) % 29 = 0 THEN NULL ELSE x*20 + y END AS sigma
        FROM atoms
    """,
    "log_lines": """
        SELECT mol_id AS file_id, atom_index*3 + k.k AS line_no,
               CASE k.k WHEN 0 THEN ' Nucleus  ' || CAST(atom_index AS string) || ' ' || symbol || ' :'
                        WHEN 1 THEN '   Isotropic shielding:    ' || CAST((mol_id*7 + atom_index*13) % 300 AS string) || '.' || CAST(1000 + (mol_id*3 + atom_index*17) % 9000 AS string) || ' ppm'
                        ELSE '   Shielding anisotropy:     12.3421 ppm' END AS line
        FROM atoms CROSS JOIN (VALUES (0),(1),(2)) AS k(k)
        WHERE mol_id % 5 <> 0 OR k.k <> 1
    """,
    "observed_peaks": """
        SELECT user_id*20 + event_id % 20 AS mol_id, event_id AS peak_id, value % CAST(9 AS double) AS ppm FROM events
    """,
    "signals_1h": """
        SELECT l_orderkey AS mol_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY -(l_extendedprice % CAST(9 AS double)), l_partkey, l_suppkey, l_quantity, l_linenumber) AS int) AS pos,
               l_extendedprice % CAST(9 AS double) AS center, CAST(1 + l_linenumber % 3 AS int) AS integration,
               CAST((l_orderkey % 4)*0.0175/2 AS double) AS half_width
        FROM lineitem
    """,
    "raw_strings": """
        SELECT p_partkey AS id,
               CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'C(C(=O)O' WHEN 3 THEN 'CC)O(' WHEN 4 THEN ' c1ccccc1[NH2]FP ' ELSE p_name END AS s
        FROM part
    """,
}
